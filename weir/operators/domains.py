"""Names, per-domain history, traffic-wide baselines and message patterns."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weir.operators.lookups import classify_server, flag_spoofed
from weir.plans.skew import CHUNK_ROWS, Chunked, small_side
from weir.session import ensure_checkpoint_dir

# Pattern codes (fixed values).
TTL_OK, TTL_TOO_LOW, TTL_TOO_HIGH = 0, 1, 2
REQUEST_OK, REQUEST_TOO_LARGE, REQUEST_WITH_DATA = 0, 1, 2
LABELS_OK, LABELS_TOO_LARGE, DOMAIN_HIGH_RATE, LABELS_STRANGE_ENCODING, LABELS_TOO_UNIFORM = 0, 1, 2, 3, 4
DNS_OK, DNS_MALFORMED, DNS_NOT_DNS = 0, 1, 2
MIN_TTL, MAX_TTL = 20, 40000
# Starting averages and their weight (fixed values).
PRIORS = {"ttl": 60.0, "query_size": 80.0, "name_length": 15.0, "query_rate": 5.0, "nonlc_rate": 0.3}
PRIOR_WEIGHT = 40000
EWMA_NEW, EWMA_KNOWN = 0.15, 0.015
REFRESH = "300 seconds"
# Parts of a message pattern, in the order of the printed form and of the packed form (fixed values).
PRINTED = ("src", "dst", "packet", "query", "reply", "ttl", "qname")
PACKED = ("src", "dst", "packet", "qname", "query", "reply", "ttl")


# ---- names -----------------------------------------------------------------------------------------

def with_reversed_qname(df: DataFrame, name: str = "qname") -> DataFrame:
    return df.withColumn("rname", F.reverse(name))


def domain_key(rname: Column) -> Column:
    """First two levels of a reversed full name (it starts with the dot of the root)."""
    return F.substring_index(rname, ".", 3)


def with_domain_key(df: DataFrame, name: str = "qname") -> DataFrame:
    return df.withColumn("domain_key", domain_key(F.reverse(F.col(name))))


def fill_invalid_domain(df: DataFrame, name: str = "qname") -> DataFrame:
    """Give undecodable packets the name source.destination.INVALID, so that they still count in the domain statistics."""
    sent = F.col("direction") == "OUT"
    source, target = F.when(sent, F.col("client_ip")).otherwise(F.col("server_ip")), F.when(sent, F.col("server_ip")).otherwise(F.col("client_ip"))
    stand_in = F.concat_ws(".", source.cast("string"), target.cast("string"), F.lit("INVALID"))
    return df.withColumn(name, F.coalesce(name, stand_in))


def with_message_kind(df: DataFrame) -> DataFrame:
    return df.withColumn("kind", F.when(F.col("ancount") == 0, "Query").otherwise("Reply"))


def order_by_domain(df: DataFrame, name: str = "qname") -> DataFrame:
    """Rows sorted by reversed name, which keeps the names under one domain together."""
    return df.orderBy(F.reverse(F.col(name)), name)


def nonlc_count(rname: Column) -> Column:
    """One more than the characters, the last left out, that are neither lowercase nor a dot."""
    body = F.substring(rname, F.lit(1), F.greatest(F.length(rname) - 1, F.lit(0)))
    return 1 + F.length(F.regexp_replace(body, "[a-z.]", ""))


def nonlc_rate(rname: Column) -> Column:
    return F.try_divide(nonlc_count(rname).cast("double"), F.length(rname))


# ---- per-domain history ----------------------------------------------------------------------------

# A halving average forgets a value at 2^-n, so these many rows give it to the last bit of a double.
_TAIL = 64


def domain_history(messages: DataFrame, refresh: str = REFRESH, mode: str = "window") -> DataFrame:
    """Query count, halving averages of rate, name length and non-lowercase rate, and their self-variation.

    `mode='window'`: one row per refresh window and domain, folded in `seq` order. Only the last rows of a
    window weigh on a halving average; they are found by a per-group limit that runs before the shuffle,
    so a hot domain sends a bounded number of rows. `mode='reset'`: the history restarts at each query, one
    row per message in closed form.
    """
    rows = with_domain_key(with_reversed_qname(messages)).withColumns(
        {"_len": F.length("rname").cast("double"), "_nonlc": nonlc_count(F.col("rname")),
         "_rate": nonlc_rate(F.col("rname"))})
    if mode == "reset":
        whole = F.floor(F.col("_nonlc") / F.length("rname"))
        return rows.withColumns({
            "query_rate": F.lit(1), "query_avg_rate": F.lit(1.0), "len_avg": F.col("_len"),
            "nonlc_avg_rate": whole.cast("double"), "query_rate_variation": F.lit(50.0),
            "len_variation": F.lit(50.0),
            "nonlc_rate_variation": F.when(F.col("_nonlc") > 1, F.floor((whole + 1) / 2).cast("double")).otherwise(100.0),
        }).drop("_len", "_nonlc", "_rate")
    if mode != "window":
        raise ValueError("mode must be 'window' or 'reset'")

    rows = rows.withColumn("window_start", F.window("ts", refresh)["start"])
    key = ["window_start", "domain_key"]
    base = rows.groupBy(*key).agg(
        F.count(F.lit(1)).alias("query_rate"),
        F.sum(F.when(F.col("_nonlc") > 1, 1).otherwise(0)).alias("_coded"),
        F.min_by("_len", "seq").alias("_first_len"), F.min_by("_rate", "seq").alias("_first_rate"))
    latest = Window.partitionBy(*key).orderBy(F.col("seq").desc())

    def tail(df: DataFrame, n: int, value: str, name: str) -> DataFrame:
        kept = df.withColumn("_r", F.row_number().over(latest)).where(F.col("_r") <= n)
        ordered = F.sort_array(F.collect_list(F.struct("seq", value)))
        return kept.groupBy(*key).agg(F.transform(ordered, lambda p: p[value]).alias(name))

    lens = tail(rows.select(*key, "seq", "_len"), 2 * _TAIL, "_len", "_lens")
    rates = tail(rows.where(F.col("_nonlc") > 1).select(*key, "seq", "_rate"), _TAIL, "_rate", "_rates")
    joined = base.join(lens, key).join(rates, key, "left")

    # fold of (average, variation); a fold that starts at the window's first row starts from that row
    n, kept = F.col("query_rate"), F.size("_lens")
    half = F.lit(0.5)
    first_len = F.when(n == kept, F.col("_first_len")).otherwise(F.element_at("_lens", 1))

    def step_len(acc: Column, x: Column) -> Column:
        avg = (acc["avg"] + x) * half
        var = (acc["var"] + 1 + F.abs(avg - x) / (1 + avg)) * half
        return F.struct(avg.alias("avg"), var.alias("var"))

    def step_count(acc: Column, i: Column) -> Column:
        k = (n - kept + i + 1).cast("double")
        avg = (acc["avg"] + k) * half
        var = (acc["var"] + 1 + F.abs(avg - k) / (1 + avg)) * half
        return F.struct(avg.alias("avg"), var.alias("var"))

    def start(avg: Column) -> Column:
        return F.struct(avg.cast("double").alias("avg"), F.lit(100.0).alias("var"))

    by_len = F.aggregate("_lens", start(first_len), step_len)
    # when rows before the tail are left out, the average of the count starts one behind it
    by_count = F.aggregate(F.sequence(F.lit(0), kept - 1),
                           start(F.when(n == kept, F.lit(1.0)).otherwise(n - kept)), step_count)
    early = F.when(F.col("_coded") <= _TAIL, F.col("_first_rate")).otherwise(F.element_at("_rates", 1))
    nonlc = F.aggregate(F.coalesce("_rates", F.array().cast("array<double>")), early, lambda a, x: (a + x) * half)
    last_rate = F.element_at("_rates", -1)
    return (
        joined.withColumns({"_l": by_len, "_c": by_count, "nonlc_avg_rate": nonlc})
        .withColumn("nonlc_rate_variation", F.when(
            F.col("_coded") > 0,
            (F.col("nonlc_avg_rate") + 1 + F.abs(F.col("nonlc_avg_rate") - last_rate) / (1 + F.col("nonlc_avg_rate"))) * half
        ).otherwise(100.0))
        .select(*key, "query_rate", F.col("_c.avg").alias("query_avg_rate"), F.col("_l.avg").alias("len_avg"),
                "nonlc_avg_rate", F.col("_c.var").alias("query_rate_variation"),
                F.col("_l.var").alias("len_variation"), "nonlc_rate_variation")
    )


# ---- traffic-wide baselines ------------------------------------------------------------------------

def traffic_baselines(df: DataFrame, values: Mapping[str, tuple[Column, float]], n0: int = PRIOR_WEIGHT,
                      bucket: str = REFRESH) -> DataFrame:
    """Prior-weighted means of several values (name -> value, prior) up to the end of each time bucket.

    Rows are summed per bucket first, all values in one pass; the running sums then go over one row per
    bucket. Adds `<name>_n` and `<name>`.
    """
    staged = df.select(F.window("ts", bucket)["start"].alias("window_start"),
                       *[v.cast("double").alias(n) for n, (v, _) in values.items()])
    per = staged.groupBy("window_start").agg(
        *[F.sum(n).alias(f"_s_{n}") for n in values], *[F.count(n).alias(f"_n_{n}") for n in values])
    so_far = Window.orderBy("window_start").rowsBetween(Window.unboundedPreceding, 0)
    out = []
    for name, (_, prior) in values.items():
        n = F.sum(f"_n_{name}").over(so_far)
        total = F.coalesce(F.sum(f"_s_{name}").over(so_far), F.lit(0.0))
        out += [n.alias(f"{name}_n"), ((n0 * prior + total) / (n0 + n)).alias(name)]
    return per.select("window_start", *out)


def traffic_baseline(df: DataFrame, value: str, prior: float, n0: int = PRIOR_WEIGHT,
                     bucket: str = REFRESH) -> DataFrame:
    """The baseline of one value: `window_start`, `n`, `mean`."""
    found = df.where(F.col(value).isNotNull())
    table = traffic_baselines(found, {"mean": (F.col(value), prior)}, n0, bucket)
    return table.select("window_start", F.col("mean_n").alias("n"), "mean")


def with_baselines(df: DataFrame, baselines: DataFrame, names: Mapping[str, tuple[str, float]],
                   bucket: str = REFRESH) -> DataFrame:
    """Add the baselines of each row's time bucket: new column -> (baseline column, prior where none)."""
    table = baselines.select("window_start", *[F.col(src).alias(f"_b_{c}") for c, (src, _) in names.items()])
    if "window_start" not in df.columns:
        df = df.withColumn("window_start", F.window("ts", bucket)["start"])
    df = df.join(small_side(table), "window_start", "left")
    return df.withColumns({c: F.coalesce(f"_b_{c}", F.lit(prior)) for c, (_, prior) in names.items()}).drop(
        *[f"_b_{c}" for c in names])


def rated_history(history: DataFrame) -> DataFrame:
    """Domain history with the baselines of name length, query rate and non-lowercase rate."""
    timed = history.withColumn("ts", F.col("window_start"))
    values = {"name_length": "len_avg", "query_rate": "query_avg_rate", "nonlc_rate": "nonlc_avg_rate"}
    base = traffic_baselines(timed, {n: (F.col(c), PRIORS[n]) for n, c in values.items()})
    base = base.select("window_start", *[F.col(n).alias(f"b_{n}") for n in values])
    return with_baselines(timed, base, {f"avg_{n}": (f"b_{n}", PRIORS[n]) for n in values}).drop("ts")


# ---- recurrences -----------------------------------------------------------------------------------

def ewma(df: DataFrame, value: str, alpha: float, by: Sequence[str], order: str, initial: float = 0.0,
         name: str = "ewma", chunk_rows: int | None = CHUNK_ROWS) -> DataFrame:
    """a += alpha * (d - a) along each key, at every row. A null value leaves the average as it is.

    The sum of weighted values is cut into blocks long enough that a value fades below the last bit of a
    double within one block. A block then needs only the closing value of the block before it, which comes
    by an equality join, so no key is folded in one task.
    """
    if not 0 < alpha <= 1:
        raise ValueError("alpha must be above 0 and at most 1")
    q = 1.0 - alpha
    block_rows = max(1, math.ceil(30 * math.log(10) / -math.log(q))) if q else 1
    k = Chunked(df, by, order, chunk_rows)
    # rows without a value stand with the last value before them
    k.scan({"_i": ("sum", F.when(F.col(value).isNotNull(), 1).otherwise(0), True)})
    rows = k.df.withColumn("_block", F.expr(f"(_i - 1) div {block_rows}")).withColumn(
        "_j", (F.col("_i") - 1) % block_rows + 1)
    w = Window.partitionBy(*by, "_block").orderBy("_j").rangeBetween(Window.unboundedPreceding, 0)
    weight = F.pow(F.lit(q), F.col("_j").cast("double")) if q else F.lit(1.0)
    rows = rows.withColumn("_local", F.coalesce(alpha * F.sum(F.col(value) / weight).over(w) * weight, F.lit(0.0)))
    closing = (rows.where((F.col("_j") == block_rows) & F.col(value).isNotNull())
               .select(*[F.col(c).alias(f"_k_{c}") for c in by], (F.col("_block") + 1).alias("_k_block"),
                       F.col("_local").alias("_before")))
    cond = F.col("_block") == F.col("_k_block")
    for c in by:
        cond = cond & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    joined = rows.join(closing, cond, "left")
    # the first block starts from `initial`; later blocks from the closing value before them
    before = F.when(F.col("_block") == 0, F.lit(float(initial))).otherwise(F.col("_before"))
    value_now = before * F.pow(F.lit(q), F.col("_j").cast("double")) + F.col("_local")
    return joined.withColumn(name, F.when(F.col("_i") == 0, F.lit(float(initial))).otherwise(value_now)).select(
        *df.columns, name)


def adapt_patterns(df: DataFrame, by: Sequence[str], order: str, code: str = "code", initial_code: int = 0,
                   initial_range: int = 0, initial_uniqueness: int = 0,
                   chunk_rows: int | None = CHUNK_ROWS) -> DataFrame:
    """Hysteresis of a pattern along each key: adds `held_range` and `held_uniqueness`.

    A row with the held code lifts the uniqueness (0 to 1 to 3, 2 to 3). A row with another code lowers
    range and uniqueness by one, but only while the range is at least 4, so at most four rows ever do.
    Running counts of equal and other codes, with the count of equal codes at each of those rows, fix the
    state without folding the key.
    """
    drops = max(0, initial_range - 3)
    k = Chunked(df, by, order, chunk_rows)
    same = F.col(code) == initial_code
    k.scan({"_same": ("sum", F.when(same, 1).otherwise(0), True),
            "_other": ("sum", F.when(same, 0).otherwise(1), True)})
    if drops:
        k.scan({f"_at{j}": ("max", F.when(~same & (F.col("_other") == j), F.col("_same")), True)
                for j in range(1, drops + 1)})

    def lift(u: Column, times: Column) -> Column:
        return F.when(times >= 2, 3).when(times == 1, F.when(u == 0, 1).otherwise(3)).otherwise(u)

    u, since = F.lit(initial_uniqueness), F.lit(0)
    for j in range(1, drops + 1):
        at = F.col(f"_at{j}")
        u = F.when(at.isNull(), u).otherwise(F.pmod(lift(u, at - since) - 1, F.lit(4)))
        since = F.coalesce(at, since)
    held = F.lit(initial_range) - F.least(F.col("_other"), F.lit(drops))
    return k.df.withColumns({"held_range": held.cast("int"),
                             "held_uniqueness": lift(u, F.col("_same") - since).cast("int")}).drop(
        "_same", "_other", *[f"_at{j}" for j in range(1, drops + 1)], "_chunk")


# ---- patterns --------------------------------------------------------------------------------------

def _bits(x: Column) -> Column:
    return x.cast("long").bitwiseAND(F.lit(7)).cast("int")


def _one_shifted(shift: Column) -> Column:
    """Low three bits of 1 << shift."""
    return F.when(shift.between(0, 2), F.pow(F.lit(2.0), shift.cast("double"))).otherwise(0).cast("int")


def ttl_pattern(df: DataFrame, ttl: str = "ttl", avg: str = "avg_ttl") -> DataFrame:
    """Add ttl_code, ttl_range, ttl_uniq against the traffic-wide average. Null ttl gives nulls."""
    t, a = F.col(ttl).cast("double"), F.col(avg)
    low = t < F.least(F.lit(float(MIN_TTL)), a / 10)
    high = t > F.greatest(F.lit(float(MAX_TTL)), a * 10)
    code = F.when(low, TTL_TOO_LOW).when(high, TTL_TOO_HIGH).when(t.isNotNull(), TTL_OK)
    level = (F.when(low, _bits(F.floor(8 * t / MIN_TTL)))
             .when(high, _one_shifted(F.floor(t / (8 * MAX_TTL))))
             .otherwise(_one_shifted(F.floor(8 * t / a))))
    # a normal value pulls the average half way before the distance to it is taken
    gap = F.when(low | high, F.abs(t - a)).otherwise(F.abs(t - a) / 2)
    product = F.abs(t - a) * gap / (1 + F.col("ttl_range"))
    uniq = F.floor(product - 4.0 * F.floor(product / 4)).cast("int")
    return df.withColumn("ttl_code", code).withColumn("ttl_range", level).withColumn("ttl_uniq", uniq)


def query_size_pattern(df: DataFrame, length: str = "len", avg: str = "avg_query_size") -> DataFrame:
    """Add query_code and query_range from size, question count and data in the other sections."""
    n, a = F.col(length).cast("double"), F.col(avg)
    none = F.col("qdcount") == 0
    large = n > a * 2
    data = (F.col("ancount") > 0) | (F.col("nscount") > 0) | (F.col("arcount") > 0)
    code = F.when(none, REQUEST_WITH_DATA).when(large, REQUEST_TOO_LARGE).when(data, REQUEST_WITH_DATA).otherwise(REQUEST_OK)
    level = (F.when(none, 0).when(large, _bits(F.floor(n / a))).when(data, _bits(F.floor(n * 1.5 / a))).otherwise(0))
    return df.withColumns({"query_code": code, "query_range": level.cast("int")})


def qname_pattern(df: DataFrame, avg_len: str = "avg_name_length", avg_rate: str = "avg_query_rate",
                  avg_nonlc: str = "avg_nonlc_rate") -> DataFrame:
    """Add qname_code and qname_range to rows of domain history with their baselines; the first match wins."""
    ln, rate, nonlc = F.col("len_avg"), F.col("query_rate").cast("double"), F.col("nonlc_avg_rate")
    vq, vl, vn = F.col("query_rate_variation"), F.col("len_variation"), F.col("nonlc_rate_variation")
    large = ln > F.col(avg_len) * 3
    fast = (rate > F.col(avg_rate) * 2) & (vl < 50)
    strange = (nonlc > F.col(avg_nonlc) * 1.5) & (vn < 50)
    uniform = ((vl < 25) | (vn < 50)) & (vq < 50)
    code = (F.when(large, LABELS_TOO_LARGE).when(fast, DOMAIN_HIGH_RATE).when(strange, LABELS_STRANGE_ENCODING)
            .when(uniform, LABELS_TOO_UNIFORM).otherwise(LABELS_OK))

    def doubled(x: Column) -> Column:
        return _bits(F.floor(x) * 2)

    mixed = vq.cast("long").bitwiseOR(vn.cast("long")).bitwiseOR(vl.cast("long"))
    level = (F.when(large, doubled(ln * 3 / F.col(avg_len))).when(fast, doubled(rate * 2 / F.col(avg_rate)))
             .when(strange, doubled(nonlc * 3 / F.col(avg_nonlc))).when(uniform, _bits(mixed)).otherwise(0))
    return df.withColumns({"qname_code": code, "qname_range": level.cast("int")})


def message_patterns(messages: DataFrame, nameservers: DataFrame | None = None, blacklist: DataFrame | None = None,
                     scores: DataFrame | None = None, local_addrs: DataFrame | None = None) -> DataFrame:
    """Pattern of each message: outcome, source, server, and ttl for replies or size and name for queries.

    Averages are the traffic-wide baselines of the message's time bucket, name history is that of its domain
    in the bucket. Messages need packet_code, qname, ttl, len, the four section counts and the flow columns.
    """
    df = fill_invalid_domain(messages).withColumn("window_start", F.window("ts", REFRESH)["start"])
    ok, reply = F.col("packet_code") == DNS_OK, F.col("ancount") > 0
    named = df.where(~ok | (~reply & (F.col("qdcount") > 0)))
    base = traffic_baselines(df, {"b_ttl": (F.when(ok & reply, F.col("ttl")), PRIORS["ttl"]),
                                  "b_size": (F.when(ok & ~reply, F.col("len")), PRIORS["query_size"])})
    df = with_baselines(df, base, {"avg_ttl": ("b_ttl", PRIORS["ttl"]),
                                   "avg_query_size": ("b_size", PRIORS["query_size"])})
    # one row per domain and bucket, read twice below
    ensure_checkpoint_dir(df.sparkSession)
    history = domain_history(named).checkpoint()
    coded = qname_pattern(rated_history(history)).select("window_start", "domain_key", "qname_code", "qname_range")
    df = with_domain_key(df).join(coded, ["window_start", "domain_key"], "left")
    df = query_size_pattern(ttl_pattern(df))
    df = classify_server(flag_spoofed(df, local_addrs), nameservers, blacklist, scores)
    zero = F.lit(0)
    is_named = ~ok | (~reply & (F.col("qdcount") > 0))

    def only(cond: Column, column: str) -> Column:
        return F.when(cond, F.coalesce(column, zero)).otherwise(zero).cast("int")

    df = df.withColumns({
        "src_code": F.when(F.col("spoofed"), 2).otherwise(0),
        "dst_code": only(~F.col("spoofed"), "dst_code"), "dst_range": only(~F.col("spoofed"), "dst_range"),
        "query_code": only(ok & ~reply, "query_code"), "query_range": only(ok & ~reply, "query_range"),
        "ttl_code": only(ok & reply, "ttl_code"), "ttl_range": only(ok & reply, "ttl_range"),
        "ttl_uniq": only(ok & reply, "ttl_uniq"),
        "qname_code": only(is_named, "qname_code"), "qname_range": only(is_named, "qname_range"),
    })
    present = set(df.columns)
    missing = {f"{p}_{f}": F.lit(0) for p in PRINTED for f in ("code", "range", "uniq") if f"{p}_{f}" not in present}
    return df.withColumns(missing).drop("avg_ttl", "avg_query_size", "spoofed")


def packed(part: str) -> Column:
    """code << 5 | range << 3 | uniqueness; the range reaches into the code's lowest bit."""
    code, level, uniq = (F.col(f"{part}_{f}").cast("int") for f in ("code", "range", "uniq"))
    return F.shiftleft(code, 5).bitwiseOR(F.shiftleft(level, 3)).bitwiseOR(uniq)


def pack_pattern(df: DataFrame, name: str = "point") -> DataFrame:
    return df.withColumn(name, F.array(*[packed(p) for p in PACKED]))


def pattern_string(df: DataFrame, name: str = "pattern") -> DataFrame:
    args = [F.col(f"{p}_{f}").cast("int") for p in PRINTED for f in ("code", "range", "uniq")]
    return df.withColumn(name, F.format_string("".join(f"{p.upper()}:%d|%d|%d, " for p in PRINTED), *args))
