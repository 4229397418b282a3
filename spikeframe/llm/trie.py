"""The prefix trie of rebuilt conversations, from fingerprints that multiply.

A sequence of turns has as its fingerprint the sum of x(i) B^i over its turns (x: residues of the
turn's SHA-256), modulo a prime, in four rings at once. Fingerprints form a monoid: of s followed by t
it is F(s) + B^|s| F(t), and a piece of a conversation is a difference of two prefixes, shifted. So the prefixes
of a conversation that starts with another one's head are put together from the prefix sums of both as they are
stored; no rebuilt text exists anywhere. Prefix sums run over the whole table in order, by parts, so a
conversation may be of any length, and what joins a conversation's rows does so by blocks of rows.

Rows of one depth and fingerprint are a node. Each row refers to the stored turn that its prefix ends with; a node
holds only if all its rows have the same parent and the turns that they refer to are equal in role and
text. Where one is not, the whole is done again in other rings.

Sums over subtrees come from the members: a member adds to a node what its own path has from there down, of nodes
that several share for every member but the smallest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialise, meet, with_defaults

#: Turns that a head may have at most.
HEAD = 3
#: Conversations from one multiple of this to the next share their head's source.
FAMILY = 20
#: Rows of the ordered table in a block.
BLOCK = 1 << 16


@dataclass(frozen=True)
class Ring:
    """Arithmetic modulo a prime, with four bases."""

    prime: int
    bases: tuple[int, int, int, int]

    def power(self, k: int, e: Column) -> Column:
        """B^e for a whole number e of 0 or more."""
        small = F.pmod(e, F.lit(self.prime - 1))
        squares = F.array(*[F.lit(pow(self.bases[k], 1 << i, self.prime)).cast("long") for i in range((self.prime - 1).bit_length())])
        factors = F.transform(squares, lambda s, i: F.when(F.getbit(small, i) == 1, s).otherwise(F.lit(1).cast("long")))
        return F.aggregate(factors, F.lit(1).cast("long"), lambda acc, s: acc * s % self.prime)

    def shift(self, k: int, back: Column) -> Column:
        """B^-back for back from 0 to HEAD."""
        inverse = pow(self.bases[k], -1, self.prime)
        return F.get(F.array(*[F.lit(pow(inverse, i, self.prime)).cast("long") for i in range(HEAD + 1)]), back.cast("int"))


#: Tried one after another, until no two sequences share a fingerprint.
RINGS = tuple(Ring(2**31 - 1, tuple(pow(7, 1000003 * (4 * t + k) + 17, 2**31 - 1) for k in range(4))) for t in range(4))
N = range(4)
KEY = ["d", *[f"f{k}" for k in N]]
PARENT = ["up", *[f"e{k}" for k in N]]


def _named(prefix: str) -> list[str]:
    return [f"{prefix}{k}" for k in N]


def stored_turns(conversations: DataFrame) -> DataFrame:
    """(ref, conv_id, turn, role, text, digest, words): the turns with a number to refer to, as a written table."""
    role, text = with_defaults("role"), with_defaults("text")
    content = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.monotonically_increasing_id().alias("ref"),
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        role.alias("role"),
        text.alias("text"),
        F.sha2(content.cast("binary"), 256).alias("digest"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"),
    )
    return materialise(rows, "turns")


def in_order(turns: DataFrame) -> DataFrame:
    """(ref, conv_id, digest, words, part, g), written: the turns sorted by conversation and turn, g their place in the table."""
    order = ["conv_id", F.asc_nulls_first("turn"), "role", "digest"]
    rows = turns.select("ref", "conv_id", "turn", "role", "digest", "words").repartitionByRange(*order)
    rows = materialise(rows.withColumn("part", F.spark_partition_id()), "turns-in-order")
    within = Window.partitionBy("part").orderBy(*order, "ref")
    placed = rows.withColumn("at", F.row_number().over(within)).join(F.broadcast(_before(rows, n=F.lit(1))), "part")
    return materialise(placed.select("ref", "conv_id", "digest", "words", "part", (F.col("n") + F.col("at") - 1).alias("g")), "turns-placed")


def _before(rows: DataFrame, **sums: Column) -> DataFrame:
    """(part, sums): totals of the parts before each part; one row for each part."""
    totals = rows.groupBy("part").agg(*[F.sum(v).alias(c) for c, v in sums.items()])
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("part", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).cast("long").alias(c) for c in sums])


def prefix_products(placed: DataFrame, ring: Ring) -> tuple[DataFrame, DataFrame]:
    """Fingerprints of all prefixes of the stored conversations, and a row for each conversation.

    (conv_id, g, ref, pos, p0.. with the turn, q0.. without it, words, total with the turn), written; (conv_id, n, g, total).
    """
    p = ring.prime
    x = lambda k: F.pmod(F.conv(F.substring("digest", 8 * k + 1, 8), 16, 10).cast("long"), F.lit(p))
    terms = placed.select("ref", "conv_id", "part", "g", "words", *[(x(k) * ring.power(k, F.col("g")) % p).alias(f"y{k}") for k in N])
    earlier = Window.partitionBy("part").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    so_far = {f"s{k}": F.coalesce(F.sum(f"y{k}").over(earlier), F.lit(0)) for k in N} | {"sw": F.coalesce(F.sum("words").over(earlier), F.lit(0))}
    rows = materialise(terms.withColumns(so_far), "turn-sums")
    before = _before(rows, **{f"b{k}": F.col(f"y{k}") for k in N}, bw=F.col("words"))
    rows = rows.join(F.broadcast(before), "part").withColumns({f"s{k}": (F.col(f"s{k}") + F.col(f"b{k}") % p) % p for k in N} | {"sw": F.col("sw") + F.col("bw")})
    start = F.min(F.struct("g", *_named("s"), "sw")).alias("start")
    convs = materialise(rows.groupBy("conv_id").agg(start, F.count("*").alias("n"), F.sum("words").alias("total")), "conversations")
    unit = {f"u{k}": ring.power(k, F.lit(p - 1) - F.pmod(F.col("start.g"), F.lit(p - 1))) for k in N}
    convs = convs.withColumns(unit).withColumn("g", F.col("start.g"))
    near = rows.withColumn("block", _block("g")).join(_by_block(convs).select("conv_id", "block", "start", *unit), ["conv_id", "block"])
    since = lambda k, v: F.pmod(v - F.col(f"start.s{k}"), F.lit(p)) * F.col(f"u{k}") % p
    made = near.select(
        "conv_id", "g", "ref", (F.col("g") - F.col("start.g")).alias("pos"), "words", (F.col("sw") + F.col("words") - F.col("start.sw")).alias("total"),
        *[since(k, F.col(f"s{k}") + F.col(f"y{k}")).alias(f"p{k}") for k in N], *[since(k, F.col(f"s{k}")).alias(f"q{k}") for k in N],
    )
    return materialise(made, "prefixes"), convs.select("conv_id", "n", "g", "total")


def _block(g: str) -> Column:
    return F.floor(F.col(g) / BLOCK).cast("long")


def _by_block(convs: DataFrame) -> DataFrame:
    """convs once for each block of the ordered table that their turns lie in."""
    return convs.withColumn("block", F.explode(F.sequence(_block("g"), F.floor((F.col("g") + F.col("n") - 1) / BLOCK).cast("long"))))


def rebuilt_paths(prefixes: DataFrame, convs: DataFrame, ring: Ring) -> DataFrame:
    """A row for each prefix of each rebuilt conversation, written: its node and the node's parent, the turn it ends with, and words.

    (conv_id, block, len, whole, d, f0.., up, e0.., ref, w, total): whole the words of the rebuilt conversation, total
    those of the prefix, w those of its last turn.
    """
    p, zero = ring.prime, F.lit(0).cast("long")
    entry = F.struct("pos", *_named("p"), "total", "words", "ref")
    heads = prefixes.where(F.col("pos") < HEAD).groupBy("conv_id").agg(F.array_sort(F.collect_list(entry)).alias("head"))
    base = heads.select(F.col("conv_id").alias("base"), F.col("head").alias("base_head"))
    plan = convs.join(heads, "conv_id").withColumn("base", F.col("conv_id") - F.col("conv_id") % FAMILY).join(base, "base", "left")
    plan = plan.withColumn("h", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (HEAD + 1)).cast("int"))
    plan = plan.withColumn("taken", F.least("h", F.coalesce(F.size("base_head"), F.lit(0)))).withColumn("own", F.greatest(F.col("n") - F.col("h"), zero))
    upto = lambda rows, n, name: F.coalesce(F.when(F.col(n) > 0, F.get(F.col(rows), F.col(n) - 1)[name]), zero)
    plan = plan.withColumns(
        {f"hb{k}": upto("base_head", "taken", f"p{k}") for k in N}
        | {f"ho{k}": upto("head", "h", f"p{k}") for k in N}
        | {"words_b": upto("base_head", "taken", "total"), "words_o": upto("head", "h", "total")}
    )
    whole = F.col("words_b") + F.when(F.col("own") > 0, F.col("total") - F.col("words_o")).otherwise(zero)
    plan = plan.withColumns({"len": F.col("taken") + F.col("own"), "whole": whole}).drop("total")
    plan = materialise(plan, "plan")
    kept = ["conv_id", "block", "len", "whole"]

    def node(i: Column, of: Column, before: Column) -> Column:
        at = lambda entry, there, k: F.when(there, entry[f"p{k}"]).otherwise(zero)
        this, prior = [at(of, i >= 0, k).alias(f"f{k}") for k in N], [at(before, i > 0, k).alias(f"e{k}") for k in N]
        words = [F.when(i >= 0, of["words"]).otherwise(zero).alias("w"), F.when(i >= 0, of["total"]).otherwise(zero).alias("total")]
        return F.struct((i + 1).cast("long").alias("d"), *this, i.cast("long").alias("up"), *prior, F.when(i >= 0, of["ref"]).alias("ref"), *words)

    # the root (-1) and the head's prefixes
    places = F.sequence(F.lit(-1), F.col("taken") - 1)
    of = lambda i: F.get(F.col("base_head"), i)
    first = plan.withColumn("block", _block("g")).select(*kept, F.inline(F.transform(places, lambda i: node(i, of(i), of(i - 1)))))

    own = prefixes.withColumn("block", _block("g")).join(_by_block(plan).drop("g", "head", "base_head"), ["conv_id", "block"]).where(F.col("pos") >= F.col("h"))
    joined = lambda k, name: (F.col(f"hb{k}") + F.pmod(F.col(f"{name}{k}") - F.col(f"ho{k}"), F.lit(p)) * ring.shift(k, F.col("h") - F.col("taken"))) % p
    d = F.col("taken") + F.col("pos") - F.col("h")
    then = own.select(
        *kept, (d + 1).cast("long").alias("d"), *[joined(k, "p").alias(f"f{k}") for k in N], d.cast("long").alias("up"), *[joined(k, "q").alias(f"e{k}") for k in N],
        "ref", F.col("words").alias("w"), (F.col("words_b") + F.col("total") - F.col("words_o")).alias("total"),
    )
    return materialise(first.unionByName(then), "paths")


def _nodes(paths: DataFrame) -> DataFrame:
    """A row for each depth and fingerprint, written; lo and hi columns show where its members differ."""
    ends = [f(c).alias(f"{name}_{c}") for c in (*_named("e"), "ref") for name, f in (("lo", F.min), ("hi", F.max))]
    every = [F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.min("up").alias("up"), F.min(F.col("total") - F.col("w")).alias("before")]
    return materialise(paths.groupBy(*KEY).agg(*every, *ends), "nodes")


def same_prefixes(paths: DataFrame, nodes: DataFrame, turns: DataFrame) -> bool:
    """Whether every node's members have one parent, and refer to turns that are equal in role and text."""
    differ = F.lit(False)
    for k in N:
        differ = differ | (F.col(f"lo_e{k}") != F.col(f"hi_e{k}"))
    if not nodes.where(differ).isEmpty():
        return False
    # a node whose rows refer to one stored turn needs no look at it
    refs = materialise(paths.where("d > 0").select(*KEY, "ref").distinct(), "turn-references")
    doubtful = meet(refs, nodes.where("lo_ref <> hi_ref").select(*KEY), KEY)
    turn = F.struct("role", "text")
    texts = doubtful.join(turns.select("ref", "role", "text"), "ref").groupBy(*KEY).agg(F.min(turn).alias("lo"), F.max(turn).alias("hi"))
    return texts.where("lo <> hi").isEmpty()


def _hash_of_ids(ends: DataFrame) -> DataFrame:
    """(KEY, ends_sha256) of (KEY, conv_id): ids in order, joined by commas.

    Ids are sorted by ranges; what each range has of a node becomes one string, and a node's strings go through one hash in
    order as a stream, so that no task holds a node's ids.
    """
    dealt = ends.repartitionByRange(*KEY, "conv_id").withColumn("part", F.spark_partition_id())
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda i: i.cast("string")), ",")
    pieces = materialise(dealt.groupBy(*KEY, "part").agg(F.min("conv_id").alias("first"), ids.alias("ids")), "ends")

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, running = None, None
        for pdf in batches:
            out = []
            for *now, ids in pdf[[*KEY, "ids"]].itertuples(index=False, name=None):
                if now != key:
                    if key is not None:
                        out.append((*key, running.hexdigest()))
                    key, running = now, hashlib.sha256()
                else:
                    running.update(b",")
                running.update(ids.encode())
            if out:
                yield pd.DataFrame(out, columns=[*KEY, "ends_sha256"])
        if key is not None:
            yield pd.DataFrame([(*key, running.hexdigest())], columns=[*KEY, "ends_sha256"])

    sent = pieces.select(*KEY, "first", "ids").repartition(*KEY).sortWithinPartitions(*KEY, "first")
    return sent.mapInPandas(task, ", ".join(f"{c} long" for c in KEY) + ", ends_sha256 string")


def prefix_trie(conversations: DataFrame, rings: tuple[Ring, ...] = RINGS) -> DataFrame:
    """One row per node of the trie of rebuilt conversations.

    conversations (conv_id, turn, role, text). Conversation c is rebuilt as the first h turns of conversation c - c % 20 (crc32
    of c in decimal, modulo 4, is h; fewer where that has fewer, none where there is none), then its own from the h-th on. Nodes are
    the distinct sequences of first turns; members of a node are the rebuilt conversations that begin with it, also one without turns.

    conv_id (smallest member) and depth name the node, parent_conv_id its parent's smallest member (null for the
    root); n_convs, n_children, n_leaves (childless nodes of its subtree), saved_tokens (over the subtree, n_convs - 1 times the words of
    each node's last text), ends_sha256 (of the sorted ids of the members that end here).

    Turns go by number, null first, of equal numbers by role, then by SHA-256 of role and text; repeated rows are turns
    of their own. Null roles and texts are empty, rows without conv_id are left out, an empty table has no rows (not
    even a root), and other columns are not read.
    """
    turns = stored_turns(conversations)
    placed = in_order(turns)
    for ring in rings:
        prefixes, convs = prefix_products(placed, ring)
        paths = rebuilt_paths(prefixes, convs, ring)
        nodes = _nodes(paths)
        if same_prefixes(paths, nodes, turns):
            return _described(nodes, paths, convs)
    raise ValueError("different prefixes share their fingerprints in every ring")


def _described(nodes: DataFrame, paths: DataFrame, convs: DataFrame) -> DataFrame:
    up = nodes.withColumns({f"e{k}": F.col(f"lo_e{k}") for k in N})
    children = up.where("d > 0").groupBy(F.col("up").alias("d"), *[F.col(f"e{k}").alias(f"f{k}") for k in N]).agg(F.count("*").alias("n_children"))
    nodes = up.join(children, KEY, "left").select(*KEY, *PARENT, "conv_id", "n_convs", "before", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"))
    nodes = materialise(nodes, "nodes-children")
    # from where on a conversation is the smallest of its nodes (always to its end), and whether it names a leaf
    owner = nodes.groupBy("conv_id").agg(F.min(F.struct("d", "before"))["before"].alias("alone"), F.max(F.when(F.col("n_children") == 0, 1).otherwise(0)).alias("leaf"))
    owner = _by_block(convs.join(owner, "conv_id")).select("conv_id", "block", "alone", "leaf")
    shares = paths.join(owner, ["conv_id", "block"], "left")
    saved = F.greatest(F.coalesce("alone", "whole") - (F.col("total") - F.col("w")), F.lit(0))
    sums = shares.groupBy(*KEY).agg(F.sum(saved).cast("long").alias("saved_tokens"), F.sum(F.coalesce("leaf", F.lit(0))).cast("long").alias("n_leaves"))
    ends = _hash_of_ids(paths.where(F.col("d") == F.col("len")).select(*KEY, "conv_id"))
    parents = nodes.select(F.col("d").alias("up"), *[F.col(f"f{k}").alias(f"e{k}") for k in N], F.col("conv_id").alias("parent_conv_id"))
    below = materialise(nodes.where("d > 0"), "nodes-below")
    named = meet(below, parents, PARENT).unionByName(nodes.where("d = 0").withColumn("parent_conv_id", F.lit(None).cast("long")))
    out = named.join(sums, KEY).join(ends, KEY, "left")
    return out.select(
        "conv_id", F.col("d").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )
