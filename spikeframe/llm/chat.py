"""Chat formatting by perspective rotation.

Every participant of a dialogue in turn is the assistant: the dialogue is rendered
once for each, with that speaker's turns as the assistant's, all others as named
users, and the mask on what the assistant says. Long dialogues come in parts of
consecutive turns, with positions in the whole rendering; turns are placed by prefix sums over
a range sort, so that a dialogue of any length is cut without meeting in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import HOT_SHARE, materialise, prefix_sums, with_defaults

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
#: Roles that frame a dialogue and never take part in it.
FRAMES = ("system",)
#: Tasks that the turns of a hot dialogue are dealt to.
SALTS = 64
#: Turns in one part.
PART_TURNS = 256


def rotate(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", frames=FRAMES) -> DataFrame:
    """One row per turn and perspective: head, body and tail of the rendering, and whether the body is masked in.

    Null roles are unnamed users and no perspective; null texts are empty; a dialogue of
    frames alone has no perspective. Marks of the template inside a text get a backslash.
    """
    rows = turns.select(
        F.col(conv_col).alias("conv_id"),
        F.col(turn_col).alias("turn"),
        F.col(role_col).alias("speaker"),
        F.replace(with_defaults(text_col), F.lit("<|"), F.lit("<\\|")).alias("body"),
    )
    people = rows.where(F.col("speaker").isNotNull() & ~F.col("speaker").isin(*frames)).select(F.col("conv_id").alias("of"), F.col("speaker").alias("perspective")).distinct()
    # a dialogue of more than one turn in HOT_SHARE meets its participants in SALTS places; there are fewer than HOT_SHARE of these
    many = rows.groupBy("conv_id").agg(F.count("*").alias("n"))
    hot = materialise(many.where(F.col("n") * HOT_SHARE > rows.count()).select(F.col("conv_id").alias("hot"), F.lit(True).alias("is_hot")), "hot-dialogues")
    marked = lambda df, key: df.join(F.broadcast(hot), F.col(key).eqNullSafe(F.col("hot")), "left").drop("hot")
    salt = F.when(F.col("is_hot"), F.pmod(F.xxhash64("turn", "speaker", "body"), F.lit(SALTS))).otherwise(F.lit(0).cast("long"))
    places = F.when(F.col("is_hot"), F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    turns_at = marked(rows, "conv_id").withColumn("salt", salt).drop("is_hot")
    people_at = marked(people, "of").select("of", "perspective", F.explode(places).alias("place"))
    seen = turns_at.join(people_at, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("salt") == F.col("place"))).drop("of", "salt", "place")
    own = F.col("speaker").eqNullSafe(F.col("perspective"))
    name = F.when(own, "assistant").when(F.col("speaker").isin(*frames), F.col("speaker")).when(F.col("speaker").isNull(), "user").otherwise(F.concat(F.lit("user name="), "speaker"))
    return seen.select(
        "conv_id",
        "perspective",
        "turn",
        own.alias("masked"),
        F.concat(F.lit(OPEN), name, F.lit("\n")).alias("head"),
        F.concat("body", F.lit(CLOSE)).alias("body"),
    )


def render(turns: DataFrame, **columns) -> DataFrame:
    """One row per dialogue, perspective and part: n_turns, start, n_chars, text, mask.

    A part has PART_TURNS turns, the last one the rest. start is the part's position in the whole rendering (code points) and mask its
    assistant spans there, "begin:end" with commas: what the assistant says with its end mark.
    Turns go by number, null last; turns of equal number by role and text. Repeated
    rows are repeated turns, long texts are rendered whole. Other columns are not read. An empty table gives no rows.
    """
    rows = rotate(turns, **columns).withColumn("late", F.col("turn").isNull())
    order = [F.col(c) for c in ("conv_id", "perspective", "late", "turn", "head", "body", "masked")]
    length = F.char_length("head") + F.char_length("body") + 1
    placed = prefix_sums(rows, order, "chat-turns", "dealt", place=F.lit(1).cast("long"), at=length.cast("long"))
    # where each dialogue begins, told to the range parts that it goes through
    keys = ("conv_id", "perspective", "dealt")
    begun = placed.groupBy(*keys).agg(F.min("place").alias("__place"), F.min("at").alias("__at"))
    whole = Window.partitionBy("conv_id", "perspective")
    begun = begun.select(*[F.col(k).alias(f"__{k}") for k in keys], F.min("__place").over(whole).alias("__place"), F.min("__at").over(whole).alias("__at"))
    near = placed.join(begun, (F.col("dealt") == F.col("__dealt")) & (F.col("perspective") == F.col("__perspective")) & F.col("conv_id").eqNullSafe(F.col("__conv_id")))
    begin = F.col("at") - F.col("__at")
    piece = F.struct("place", begin.alias("at"), "head", "body", "masked")
    near = near.select("conv_id", "perspective", F.floor((F.col("place") - F.col("__place")) / PART_TURNS).alias("part"), piece.alias("piece"))
    parts = near.groupBy("conv_id", "perspective", "part").agg(F.array_sort(F.collect_list("piece")).alias("pieces"))

    def span(p: Column) -> Column:
        start = p["at"] + F.char_length(p["head"])
        return F.concat_ws(":", start, start + F.char_length(p["body"]))

    text = F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"], F.lit("\n"))), "")
    mask = F.array_join(F.transform(F.filter("pieces", lambda p: p["masked"]), span), ",")
    out = parts.select("conv_id", "perspective", "part", F.size("pieces").cast("long").alias("n_turns"), F.get("pieces", F.lit(0))["at"].alias("start"), text.alias("text"), mask.alias("mask"))
    return out.select("conv_id", "perspective", "part", "n_turns", "start", F.char_length("text").cast("long").alias("n_chars"), "text", "mask")
