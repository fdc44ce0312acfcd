"""Plain loops that state what models compute, row by row, without any of the library's code."""

import math

import numpy as np


def predictor(events):
    """The prequential model from its equations, every moment taken anew over all rows learned from.

    events: ('predict', id, features by name, mid) and ('learn', id, outcome), in order; the predictions made.
    """
    sig, clip = (lambda v: 1 / (1 + math.exp(-v))), (lambda p, e: min(max(p, e), 1 - e))
    lo = lambda p: math.log(p / (1 - p))
    heads = {"m": {"z_dist": 1.8, "log_tau": 0.0}, "o": {"momentum": 0.4, "efficiency": 0.0}, "b": {"ob_imbalance": 0.6}}
    bias, score, k = dict.fromkeys(heads, 0.0), dict.fromkeys([*heads, "f"], -0.6931), 0.5
    past, cal, err, trans, last, out, open_ = [], {b: [1.0, 0.5] for b in range(10)}, 0.1, {}, None, [], {}

    def std(name, x):
        v = [r[name] for r in past]
        sd = np.std(v) if len(v) > 5 else 1.0
        return (x[name] - np.mean(v)) / (sd if sd > 1e-9 else 1.0) if len(v) > 5 else x[name]

    def probs(x, mid):
        p = {h: sig(bias[h] + sum(w * std(n, x) for n, w in ws.items())) for h, ws in heads.items()}
        return p | {"f": sig(lo(clip(mid, 1e-4)) + k * std("z_dist", x))}

    for kind, key, *given in events:
        if kind == "predict":
            x, mid = given
            vols = [r["realized_vol"] for r in past]
            mean, sd = (np.mean(vols), np.std(vols)) if vols else (0, 1)
            if len(vols) > 10 and x["realized_vol"] > mean + 2 * sd:
                regime = "panic"
            else:
                hi, low = (mean + 0.5 * sd, mean - 0.5 * sd) if len(vols) > 5 else (x["realized_vol"],) * 2
                regime = ("high_vol" if x["realized_vol"] >= hi else "low_vol" if x["realized_vol"] <= low else "mid_vol") + "/" + ("trend" if x["efficiency"] >= 0.45 else "mean_revert" if x["efficiency"] <= 0.2 else "chop")
            row = trans.get(last, {})
            n = sum(row.values())
            calm = 1 + sum(c / n * math.log(c / n) for c in row.values()) / math.log(max(2, len(row))) if n > 3 else 0.3
            heat = (1 + 2 * (1 - calm) + 3 * max(0, err - 0.1)) * (1.5 if regime == "panic" else 1)
            p = probs(x, mid)
            rel = {h: math.exp(s) for h, s in score.items()}
            own = sum(rel[h] * lo(clip(p[h], 1e-6)) for h in p) / sum(rel.values()) / heat
            anchor = lo(clip(mid, 1e-4))
            up = sig(anchor + max(-0.4, min(0.4, own - anchor)))
            c = cal[min(9, int(up * 10))]
            u = min(1, c[0] / 30)
            p_cal = u * (c[1] + 0.5) / (c[0] + 1) + (1 - u) * up
            out.append((key, up, p_cal, heat, regime))
            open_[key] = (x, mid, up, p_cal, regime)
            continue
        (x, mid, up, p_cal, regime), (y,) = open_.pop(key), given
        past.append(x)
        p = probs(x, mid)
        for h, ws in heads.items():
            z = {name: std(name, x) for name in ws}
            for name in ws:
                ws[name] -= 0.04 * (p[h] - y) * z[name]
            bias[h] -= 0.04 * (p[h] - y)
        k = min(4, max(0, k - 0.03 * (p["f"] - y) * std("z_dist", x)))
        for h in score:
            score[h] = 0.97 * score[h] + 0.03 * math.log(clip(p[h] if y else 1 - p[h], 1e-6))
        c = cal[min(9, int(up * 10))]
        c[0], c[1] = 0.995 * c[0] + 1, 0.995 * c[1] + y
        err = 0.97 * err + 0.03 * abs(p_cal - y)
        if last is not None:
            trans.setdefault(last, {})
            trans[last][regime] = trans[last].get(regime, 0) + 1
        last = regime
    return out


def forward(x, m):
    """Log-likelihood and smoothed states, row by row with plain sums over states."""
    k, n = len(m["mu"]), len(x)
    e = [[math.exp(-0.5 * ((v - m["mu"][s]) / m["sigma"][s]) ** 2) / (m["sigma"][s] * math.sqrt(2 * math.pi)) for s in range(k)] for v in x]
    a, ll = [], 0.0
    for t in range(n):
        row = [e[t][s] * (m["pi"][s] if t == 0 else sum(a[-1][r] * m["trans"][r][s] for r in range(k))) for s in range(k)]
        ll += math.log(sum(row))
        a.append([v / sum(row) for v in row])
    return ll
