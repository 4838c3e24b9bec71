"""What part of a quota's movement comes from elsewhere: quiet spans, limit ratios, isotonic series, calibration."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlark.operators.ordered import MINUTE_US, asof_backward
from meterlark.operators.scan import Scan
from meterlark.sources.shared import written

GAP_US = 30 * MINUTE_US


def attribute_events(events: DataFrame, proxy: DataFrame, timeline: DataFrame, orgs: dict[str, str] | None = None, accounts: dict[str, str] | None = None, default_profile: str | None = None, installed_us: int | None = None) -> DataFrame:
    """events(machine_id, request_id, us, org_id, account_id) with profile and level.

    Before the install the default at level unknown; else the proxy log by request, the machine's profile timeline as
    of the event, the owner (an organisation that a non-empty map lacks becomes a profile of its own), the default.
    timeline(machine_id, us, profile). Placeholder providers and other sources of the log do not count.
    """
    usable = proxy.where("source = 'proxy' AND NOT startswith(provider, '_')")
    logged = usable.groupBy("request_id").agg(F.min("provider").alias("_proxy")).where("request_id <> ''")
    both = asof_backward(events.join(logged, "request_id", "left"), timeline.select("machine_id", "us", F.col("profile").alias("_line")), ["machine_id"], "us", "_line")
    of = lambda mapping, key: F.coalesce(*[F.when(F.col(key) == k, v) for k, v in mapping.items()], F.lit(None).cast("string"))
    named = F.nullif(F.col("org_id"), F.lit(""))
    by_org = F.when(named.isNotNull(), F.coalesce(of(orgs, "org_id"), F.concat(F.lit("claude-"), F.lower(F.substring("org_id", 1, 8))))) if orgs else F.lit(None).cast("string")
    fallback = F.coalesce(by_org, of(accounts or {}, "account_id"), F.lit(default_profile).cast("string"))
    early = F.lit(False) if installed_us is None else F.col("us") < installed_us
    level = F.when(early, "unknown").when(F.col("_proxy").isNotNull(), "proxy").when(F.col("_line").isNotNull(), "timeline").when(fallback.isNotNull(), "fallback").otherwise("unknown")
    profile = F.when(early, F.lit(default_profile).cast("string")).otherwise(F.coalesce("_proxy", "_line", fallback))
    return both.withColumns({"profile": profile, "level": level}).drop("_proxy", "_line")


def quiet_attribution(samples: DataFrame, events: DataFrame, keys: Sequence[str] = ("profile_id",), lead_us: int = GAP_US, gap_us: int = GAP_US) -> DataFrame:
    """By key: observed rise, the part of it that came while nothing ran here, the ambiguous part, quiet spans and gaps.

    events(keys, us). The latest event strictly before a sample tells whether one lies in [sample - lead, sample).
    """
    before = events.select(*keys, (F.col("us") + 1).alias("us"), F.col("us").alias("_event")).distinct()
    seen = asof_backward(samples, before, keys, "us", "_event")
    pairs = Scan(seen, keys).lag(_pu="us", _pp="pct").frame()
    pair = F.col("_pu").isNotNull()
    gap = pair & (F.col("us") - F.col("_pu") > gap_us)
    rise = F.col("pct") - F.col("_pp")
    up = pair & ~gap & (rise > 0)
    busy = F.col("_event").isNotNull() & (F.col("_event") >= F.col("us") - lead_us)
    return pairs.groupBy(*keys).agg(
        F.round(F.coalesce(F.sum(F.when(up, rise)), F.lit(0.0)), 6).alias("observed_pct"),
        F.round(F.coalesce(F.sum(F.when(up & ~busy, rise)), F.lit(0.0)), 6).alias("other_pct"),
        F.round(F.coalesce(F.sum(F.when(up & busy, rise)), F.lit(0.0)), 6).alias("ambiguous_pct"),
        F.count_if(up & ~busy).alias("quiet_spans"),
        F.count_if(gap).alias("gaps"),
        F.max(F.when(~pair, F.col("pct"))).alias("unobserved_pct"),
    )


def limit_ratio(short: DataFrame, long: DataFrame, keys: Sequence[str] = ("profile_id",), gap_us: int = GAP_US, arrival: str | None = None) -> DataFrame:
    """How many points of the long limit one point of the short one is: pairs at equal times, cut where either falls or a gap lies.

    With arrival, a column that orders samples of equal moments, every pair of a moment counts, by the short sample and
    then by the long one; without it a moment is one pair of its highest values.
    """
    if arrival:
        at = lambda df, name: df.select(*keys, "us", F.col("pct").alias(name), F.col(arrival).alias(f"_{name}_at"))
    else:
        at = lambda df, name: df.groupBy(*keys, "us").agg(F.max("pct").alias(name), F.lit(0).alias(f"_{name}_at"))
    order = ("us", "_s_at", "_l_at")
    pairs = at(short, "s").join(at(long, "l"), [*keys, "us"])
    cut = Scan(pairs, keys, ties=order[1:]).runs({"_s": "s", "_l": "l", "_u": "us"}, segment=(F.col("s") < F.col("_s")) | (F.col("l") < F.col("_l")) | (F.col("us") - F.col("_u") > gap_us)).frame()
    ends = cut.groupBy(*keys, "segment").agg(*[(F.max_by(c, F.struct(*order)) - F.min_by(c, F.struct(*order))).alias(f"d{c}") for c in ("s", "l")])
    sums = ends.groupBy(*keys).agg(F.sum("ds").alias("short_pct"), F.sum("dl").alias("long_pct"), F.count("*").alias("segments"))
    usable = (F.col("long_pct") >= 5) & (F.col("short_pct") > 0)
    return sums.withColumn("ratio", F.when(usable, F.round(F.try_divide("long_pct", "short_pct"), 6)))


def interval_usage(samples: DataFrame, events: DataFrame, keys: Sequence[str] = ("profile_id",), gap_us: int = GAP_US) -> DataFrame:
    """Calibration observations: for neighbouring samples that rise within the gap, the tokens by model between them.

    Samples tile the line, so each event belongs to the latest sample at or before it: one as-of join.
    """
    steps = Scan(samples, keys).lead(end_us="us", _next="pct").derive(delta_pct=F.col("_next") - F.col("pct")).frame()
    good = steps.where((F.col("end_us") > F.col("us")) & (F.col("end_us") - F.col("us") <= gap_us) & (F.col("delta_pct") > 0))
    placed = asof_backward(events, samples.select(*keys, "us", F.col("us").alias("start_us")).distinct(), keys, "us", "start_us")
    used = placed.where("start_us IS NOT NULL").groupBy(*keys, "start_us", "model").agg(F.sum("tokens").alias("tokens"), F.collect_set("machine_id").alias("_m"))
    joined = good.select(*keys, F.col("us").alias("start_us"), "end_us", "delta_pct").join(used, [*keys, "start_us"])
    return joined.groupBy(*keys, "start_us", "end_us", "delta_pct").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("model", "tokens")))).alias("tokens_by_model"),
        F.sum("tokens").alias("tokens"),
        (F.size(F.array_distinct(F.flatten(F.collect_list("_m")))) <= 1).alias("single_machine"),
    )


def isotonic(values: Sequence[float]) -> list[float]:
    """The closest non-decreasing sequence: neighbouring pools that fall are averaged until none does."""
    pools: list[list[float]] = []
    for v in values:
        pools.append([float(v), 1.0])
        while len(pools) > 1 and pools[-2][0] > pools[-1][0]:
            (m, n), (a, b) = pools.pop(), pools.pop()
            pools.append([(m * n + a * b) / (n + b), n + b])
    return [m for m, n in pools for _ in range(int(n))]


def add_to_hull(hull: list[tuple], x: float, y: float) -> None:
    """A point right of all others joins the vertices of a lower convex hull; points on an edge are none."""
    while len(hull) > 1:
        (ax, ay), (bx, by) = hull[-2], hull[-1]
        if (by - ay) * (x - bx) < (y - by) * (bx - ax):
            break
        hull.pop()
    hull.append((x, y))


def isotonic_fit(series: DataFrame, keys: Sequence[str], value: str = "pct", width_us: int = 24 * 60 * MINUTE_US) -> DataFrame:
    """series(keys, us, value) with `fitted`, the closest non-decreasing series of each key.

    The fit is the slope of the greatest convex minorant of the running sums, and hulls merge: each bucket of time gives
    the vertices of its own hull, those of a key make the whole one, and rows find their edge as of their number. Tasks
    read sorted rows and hold the vertices of one key alone: at most one for each distinct slope and bucket.
    """
    plain = [c for c in series.columns]
    summed = written(Scan(series, keys, width_us=width_us).running(_n=F.lit(1).cast("long"), _c=F.col(value).cast("double")).frame(), "running-sums")

    def hulls(batches: Iterator[pd.DataFrame], by: Sequence[str], emit) -> Iterator[pd.DataFrame]:
        """Rows sorted by `by` and _n as the hull of each group, point by point: groups are many and small, or long and few."""
        group, hull = None, []
        for batch in batches:
            out: list[tuple] = []
            starts = batch["_c"] - batch["_v"] if "_v" in batch else None
            for i, (key, n, c) in enumerate(zip(zip(*[batch[k].tolist() for k in by]), batch["_n"].tolist(), batch["_c"].tolist())):
                if key != group:
                    if group is not None:
                        out += emit(group, hull)
                    # The point before the first belongs to the hull as well; that of the whole series is (0, 0).
                    group, hull = key, [] if starts is None else [(n - 1, float(starts.iat[i]))]
                if not hull or hull[-1][0] != n:
                    add_to_hull(hull, n, c)
            yield pd.DataFrame(out, columns=names)
        if group is not None:
            yield pd.DataFrame(emit(group, hull), columns=names)

    width = len(keys)
    names = [*keys, "_n", "_y"]
    schema = ", ".join(f"{k} {series.schema[k].dataType.simpleString()}" for k in keys) + ", _n long, _y double"
    points_of = lambda group, hull: [(*group[:width], n, c) for n, c in hull]
    edges_of = lambda group, hull: [(*group[:width], a + 1, (d - c) / (b - a)) for (a, c), (b, d) in zip(hull, hull[1:])]
    points = summed.select(*keys, F.floor(F.col("us") / width_us).alias("_b"), "_n", "_c", F.col(value).cast("double").alias("_v"))
    sorted_by = lambda df, by: df.repartition(*by).sortWithinPartitions(*by, "_n")
    vertices = sorted_by(points, [*keys, "_b"]).mapInPandas(lambda x: hulls(x, [*keys, "_b"], points_of), schema).withColumnRenamed("_y", "_c")
    edges = sorted_by(vertices, keys).mapInPandas(lambda x: hulls(x, keys, edges_of), schema).withColumnRenamed("_y", "fitted")
    edges = written(edges, "hull-edges")
    return asof_backward(summed, edges, keys, "_n", "fitted", 1 << 16).select(*plain, "fitted")


def increases(series: DataFrame, keys: Sequence[str], segment: str, value: str) -> DataFrame:
    """series with the cumulative increase: a new segment adds its whole value, others their difference."""
    step = F.when(F.col("_pv").isNull() | (F.col(segment) != F.col("_ps")), F.col(value)).otherwise(F.col(value) - F.col("_pv"))
    return Scan(series, keys).lag(_pv=value, _ps=segment).running(increase=step).frame().drop("_pv", "_ps")


def solve_calibration(models: Sequence[str], gram: np.ndarray, target: np.ndarray, used: np.ndarray, square: float, rounds: int = 20_000) -> dict | None:
    """Non-negative least squares from the normal equations, by projected gradient on scaled columns.

    Gives limit (tokens of the base model for 100 %), weights relative to the base (the model with most tokens
    among those with a positive coefficient) and the relative residual; None where nothing is positive.
    """
    scale = np.sqrt(np.where(np.diag(gram) > 0, np.diag(gram), 1.0))
    g, t = gram / np.outer(scale, scale), target / scale
    step = 1 / max(float(np.linalg.eigvalsh(g).max()), 1e-300)
    x = np.zeros(len(models))
    for _ in range(rounds):
        new = np.maximum(0.0, x - step * (g @ x - t))
        moved = float(np.abs(new - x).max())
        x = new
        if moved < 1e-14:
            break
    x = x / scale
    totals = np.where(x > 0, used, -1.0)
    base = int(totals.argmax())
    if totals[base] < 0:
        return None
    limit = 1 / x[base]
    left = max(float(x @ gram @ x - 2 * x @ target + square), 0.0)
    return {"base": models[base], "limit": float(limit), "weights": {m: float(v * limit) for m, v in zip(models, x, strict=True)}, "residual": float(np.sqrt(left / max(square, 1e-300)))}


def calibrate(observations: Sequence[tuple[dict[str, float], float]], least: int = 30) -> dict | None:
    """solve_calibration() of (tokens by model, quota points) pairs; None with fewer than `least` of them."""
    if len(observations) < least:
        return None
    models = sorted({m for tokens, _ in observations for m in tokens})
    a = np.array([[tokens.get(m, 0.0) for m in models] for tokens, _ in observations])
    b = np.array([delta / 100 for _, delta in observations])
    return solve_calibration(models, a.T @ a, a.T @ b, a.sum(axis=0), float(b @ b))


def calibration(observed: DataFrame, keys: Sequence[str] = ("profile_id",), least: int = 30) -> DataFrame:
    """calibrate() for each key, from its normal equations: sums by pair of models, added up where the rows are.

    What reaches one task is a number for each pair of models, however many single-machine observations there are.
    """
    clean = observed.where("single_machine").select(*keys, "start_us", F.explode("tokens_by_model").alias("model", "tokens"), (F.col("delta_pct") / 100).alias("b"))
    other = clean.select(*keys, "start_us", F.col("model").alias("other"), F.col("tokens").alias("other_tokens"))
    pairs = clean.join(other, [*keys, "start_us"]).groupBy(*keys, "model", "other").agg(F.sum(F.col("tokens").cast("double") * F.col("other_tokens")).alias("gram"))
    single = clean.groupBy(*keys, "model").agg(F.sum(F.col("tokens") * F.col("b")).alias("target"), F.sum("tokens").cast("double").alias("used"))
    whole = observed.where("single_machine").groupBy(*keys).agg(F.count("*").alias("observations"), F.sum(F.pow(F.col("delta_pct") / 100, 2)).alias("square"))
    rows = pairs.join(single, [*keys, "model"]).join(whole, list(keys))
    names = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in observed.schema.fields if f.name in keys)

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        models = sorted(group["model"].unique())
        gram = group.pivot_table(index="model", columns="other", values="gram", fill_value=0.0).reindex(index=models, columns=models, fill_value=0.0).to_numpy()
        one = group.drop_duplicates("model").set_index("model").loc[models]
        found = solve_calibration(models, gram, one["target"].to_numpy(), one["used"].to_numpy(), float(group["square"].iloc[0])) if group["observations"].iloc[0] >= least else None
        row = {k: group[k].iloc[0] for k in keys} | {"base": None, "limit_tokens": None, "residual": None, "observations": int(group["observations"].iloc[0])}
        if found:
            row |= {"base": found["base"], "limit_tokens": round(found["limit"], 3), "residual": round(found["residual"], 6)}
        return pd.DataFrame([row])

    return rows.groupBy(*keys).applyInPandas(fit, f"{names}, base string, limit_tokens double, residual double, observations long")
