"""The adaptive decomposition and its parts as plain loops over lists, written from their description; shares no code with the library."""

import math

import numpy as np


def peaks(x, low, high, distance):
    """Tops (plateaus count once, at their middle) within a band; the highest first, then none nearer than distance."""
    tops, i = [], 1
    while i < len(x) - 1:
        j = i
        while j + 1 < len(x) and x[j + 1] == x[i]:
            j += 1
        if x[i - 1] < x[i] and j + 1 < len(x) and x[j + 1] < x[i]:
            tops.append((i + j) // 2)
        i = j + 1
    left = [t for t in tops if low <= x[t] <= high]
    kept = []
    while left:
        best = max(left, key=lambda t: (x[t], t))
        kept.append(best)
        left = [t for t in left if abs(t - best) >= distance]
    return sorted(kept)


def extend(x, ext):
    n, ch = x.shape
    out = np.zeros((n, ch * ext))
    for t in range(n):
        for i in range(ext):
            if t >= i:
                out[t, i * ch : (i + 1) * ch] = x[t - i]
    return out


def contrast(v, kind):
    return math.log(math.cosh(v)) if kind == "logcosh" else v**3 / 6


def adapt(x, w, c, units, *, batch, ext, distance, wh=7e-3, sv=3e-3, alpha=0.1, mult=3, weight=5, epochs=1, tol=1e-4, kind="logcosh", kl_calib=(None, None), adapt_wh=True, adapt_sv=True, adapt_sd=True):
    """units: dicts of unit, w, base, spikes, height, mean, std. Batch by batch: what was in force, and what came out."""
    full, w, c = extend(x, ext), np.array(w, float), np.array(c, float)
    units = [dict(u, w=np.array(u["w"], float)) for u in units]
    out = []
    for b in range(math.ceil(len(x) / batch)):
        rows = [t for t in range(b * batch, min(len(x), (b + 1) * batch))]
        if any(t < ext for t in rows):
            rows = rows[ext:]
        if not rows:
            continue
        z = np.array([w @ full[t] for t in rows])
        if len(rows) > 1:
            mean = z.mean(0)
            cov = sum(np.outer(v - mean, v - mean) for v in z) / (len(rows) - 1)
            c = (1 - alpha) * c + alpha * cov
        eig = np.linalg.eigvalsh((c + c.T) / 2)
        kl = 0.5 * (eig.sum() - len(c) - np.log(eig).sum()) if (eig > 0).all() else None
        wh_loss = ((kl - kl_calib[0]) / kl_calib[1]) ** 2 if kl is not None and kl_calib[1] else None
        step = {"batch": b, "rows": rows, "wh_loss": wh_loss, "w": w.copy(), "units": {}}
        if adapt_wh and len(rows) > 1:
            w = w - wh * (c - np.eye(len(c))) @ w
        total = 1e10 if wh_loss is None else wh_loss
        for u in units:
            ipt = [float(u["w"] @ v) for v in z]
            square = [v * v for v in ipt]
            found = peaks(square, u["base"] / mult, mult * u["spikes"], distance)
            hits = [t for t in found if square[t] > u["height"]]
            rest = [t for t in found if square[t] <= u["height"]]
            mean = sum(ipt[t] for t in hits) / (len(hits) + 1e-6)
            value = contrast(mean, kind)
            loss = ((value - u["mean"]) / u["std"]) ** 2 if value != 0 and u.get("std") else None
            total += loss or 0
            step["units"][u["unit"]] = {"ipt": ipt, "spikes": [rows[t] for t in hits], "w": u["w"].copy(), "height": u["height"], "base": u["base"], "sv_loss": loss}
            if adapt_sv and hits:
                g = [math.tanh(ipt[t]) if kind == "logcosh" else ipt[t] ** 2 / 2 for t in hits]
                grad = sum(z[t] * k for t, k in zip(hits, g)) / len(hits)
                new = u["w"].copy()
                for _ in range(epochs):
                    new = new + sv * grad
                    new = new / math.sqrt((new**2).sum())
                    lim = abs(abs((new * u["w"]).sum()) - 1)
                    u["w"] = new.copy()
                    if lim < tol:
                        break
            if adapt_sd and found:
                n = len(hits)
                if hits:
                    u["spikes"] = (weight * u["spikes"] + n * np.mean([square[t] for t in hits])) / (weight + n)
                if rest:
                    u["base"] = (weight * u["base"] + n * np.mean([square[t] for t in rest])) / (weight + n)
                u["height"] = u["spikes"] - (u["spikes"] - u["base"]) / 2
        step["total"] = total
        out.append(step)
    return out


def lower_median(values):
    return sorted(values)[(len(values) - 1) // 2]


def loss_of(steps):
    """What a search minimises: the median whitening loss, 1e10 where one is missing, and the median of the separation losses that are there."""
    wh = [s["wh_loss"] for s in steps]
    sv = [u["sv_loss"] for s in steps for u in s["units"].values() if u["sv_loss"] is not None]
    return (1e10 if any(v is None for v in wh) else lower_median(wh)) + (lower_median(sv) if sv else 0)
