"""Dispatching requests to models: choice, backoff, rate limits, and statistics about models."""

from __future__ import annotations

import ipaddress
from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablemill.operators.folds import blocks, in_order, plain

#: Models come from one configuration; more than this isn't one.
MOST_MODELS = 10_000
MODEL = "id string, name string, model string, channel_id string, weight double, safe_rps double, timeout double, temperature double, supports_advanced_params boolean, position int"


def default_rps(weight: Column) -> Column:
    return F.greatest(F.lit(0.5), F.least(weight / 10, F.lit(10.0)))


def models(spark: SparkSession, config: Sequence[Mapping]) -> DataFrame:
    """The configured models in order, with defaults; the request rate follows the weight where it isn't given."""
    if len(config) > MOST_MODELS:
        raise ValueError("too many models")
    rows = [
        (str(m["id"]), m.get("name"), m.get("model"), None if m.get("channel_id") is None else str(m["channel_id"]), float(m.get("weight", 1)), m.get("safe_rps"), float(m.get("timeout", 300)), float(m.get("temperature", 0.7)), bool(m.get("supports_advanced_params", False)), k)
        for k, m in enumerate(config)
    ]
    return spark.createDataFrame(rows, MODEL).withColumn("safe_rps", F.coalesce("safe_rps", default_rps(F.col("weight"))))


def with_channels(known: DataFrame, channels: DataFrame) -> DataFrame:
    """Models with their channel's columns and the shorter of the two timeouts; a model without its channel is an error at run time."""
    side = channels.select(F.col("id").alias("channel_id"), "base_url", F.col("timeout").alias("_channel_timeout"))
    joined = known.join(side, "channel_id", "left")
    url = F.when(F.col("base_url").isNull(), F.raise_error(F.concat(F.lit("no channel for model "), F.col("id")))).otherwise(F.col("base_url"))
    return joined.withColumn("base_url", url).withColumn("timeout", F.least("timeout", F.coalesce("_channel_timeout", "timeout"))).drop("_channel_timeout")


def name_map(known: DataFrame) -> DataFrame:
    """(asked, id): every id, model and name that a request may ask for; later models and, within one, names over models over ids win."""
    said = known.select("id", F.posexplode(F.array("id", "model", "name")).alias("kind", "asked"), "position").where("asked is not null and asked <> ''")
    return said.groupBy("asked").agg(F.max_by("id", F.struct("position", "kind")).alias("id"))


def resolve(requests: DataFrame, asked: str, known: DataFrame) -> DataFrame:
    """Adds ``wanted``: the model's id, or null for a free choice (``auto``, ``any``, ``default``, ``*``, empty or unknown)."""
    names = name_map(known).select(F.col("asked").alias("_asked"), F.col("id").alias("wanted"))
    return requests.join(names, F.col(asked) == F.col("_asked"), "left").drop("_asked")


def hash_unit(key: Column, seed: int = 0) -> Column:
    """A number in [0, 1) that depends on the key alone, so that a task run again chooses the same."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string"))), 1, 12), 16, 10).cast("double") / F.lit(float(16**12))


def weighted_pick(unit: Column, options: Sequence[tuple[str, float]]) -> Column:
    """The option in whose share of the summed weights ``unit`` falls; weights of 0 or less are never chosen, and no option gives null."""
    some = [(n, w) for n, w in options if w > 0]
    total, upto, out = sum(w for _, w in some), 0.0, F.lit(None).cast("string")
    bounds = []
    for n, w in some:
        upto += w
        bounds.append((n, upto))
    for n, b in reversed(bounds):
        out = F.lit(n) if b == total and out is not None and n == bounds[-1][0] else F.when(unit * total < b, F.lit(n)).otherwise(out)
    return out


def pick_model(requests: DataFrame, key: str, known: DataFrame, wanted: str | None = None, excluded: str | None = None, seed: int = 0) -> DataFrame:
    """Adds ``picked``: the wanted model if it is usable, or else a weighted choice among usable ones not excluded; null if there is none.

    ``known`` has id, weight, position and, where it matters, ``usable``. Its rows are one configuration's and go to each
    request as one array.
    """
    usable = known if "usable" in known.columns else known.withColumn("usable", F.lit(True))
    rows = usable.where("weight > 0 and usable").select("position", "id", "weight").orderBy("position").limit(MOST_MODELS + 1).collect()
    if len(rows) > MOST_MODELS:
        raise ValueError("too many models")
    pool = F.array(*[F.struct(F.lit(r["id"]).alias("id"), F.lit(r["weight"]).alias("w")) for r in rows]) if rows else F.array().cast("array<struct<id:string,w:double>>")
    out = requests.withColumn("_pool", pool if excluded is None else F.filter(pool, lambda m: ~F.coalesce(F.array_contains(F.col(excluded), m["id"]), F.lit(False))))
    total = F.aggregate("_pool", F.lit(0.0), lambda s, m: s + m["w"])
    aim = hash_unit(F.col(key), seed) * total
    start = F.struct(F.lit(0.0).alias("upto"), F.lit(None).cast("string").alias("id"))
    step = lambda s, m: F.struct((s["upto"] + m["w"]).alias("upto"), F.when(s["id"].isNull() & (aim < s["upto"] + m["w"]), m["id"]).otherwise(s["id"]).alias("id"))
    free = F.aggregate("_pool", start, step, lambda s: s["id"])
    asked = F.when(F.exists("_pool", lambda m: m["id"] == F.col(wanted)), F.col(wanted)) if wanted else F.lit(None).cast("string")
    return out.withColumn("picked", F.coalesce(asked, free)).drop("_pool")


def backoff_seconds(fails: Column, factor: float = 2.0) -> Column:
    """2, 4, 6 seconds, then 6 plus a power of the factor, a minute at most; 0 without failures."""
    return F.when(fails <= 0, F.lit(0.0)).when(fails <= 3, (fails * 2).cast("double")).otherwise(F.least(F.pow(F.lit(factor), fails - 3) + 6, F.lit(60.0)))


def available(next_ts: Column, now: Column) -> Column:
    return F.coalesce(now >= next_ts, F.lit(True))


def success_rates(df: DataFrame, key: str, ok: Column) -> DataFrame:
    """(key, n_ok, n_failed, rate): the rate is 1 before any request."""
    out = df.groupBy(key).agg(F.count_if(ok).alias("n_ok"), F.count_if(~ok).alias("n_failed"))
    return out.withColumn("rate", F.coalesce(F.col("n_ok") / F.nullif(F.col("n_ok") + F.col("n_failed"), F.lit(0)), F.lit(1.0)))


def health(states: DataFrame, usable: str = "usable") -> DataFrame:
    """One row: status (healthy, degraded, unhealthy), available_models, total_models."""
    rolled = states.agg(F.count_if(F.col(usable)).alias("available_models"), F.count(F.lit(1)).alias("total_models"))
    return rolled.select(F.when(F.col("available_models") == 0, "unhealthy").when(F.col("available_models") < F.col("total_models"), "degraded").otherwise("healthy").alias("status"), "*")


def exposed_models(known: DataFrame) -> DataFrame:
    """(exposed_id, id): the first model with a weight for each name under which models are shown."""
    some = lambda c: F.nullif(F.col(c), F.lit(""))
    return known.where("weight > 0").groupBy(F.coalesce(some("name"), some("model"), F.col("id")).alias("exposed_id")).agg(F.min_by("id", "position").alias("id"))


def request_params(temperature: Column, model_temperature: Column, advanced: Mapping[str, Column], supported: Column) -> dict[str, Column]:
    """The parameters to send: the request's temperature or else the model's, advanced ones only where they are supported."""
    return {"temperature": F.coalesce(temperature, model_temperature)} | {n: F.when(supported, c) for n, c in advanced.items()}


def token_bucket(df: DataFrame, key: str, ts: str, order: str, rps: float, capacity: float | None = None) -> DataFrame:
    """(key, ts, order, admitted): whether each request finds a token in its key's bucket, which starts full (twice the rate by default).

    ``ts`` is in seconds. What a request finds depends on all before it, so a key is read in order by one task, in a
    stream: memory doesn't grow with the key.
    """
    most = 2 * rps if capacity is None else capacity
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = df.select(key, F.col(ts).cast("double").alias(ts), order).repartition(n, key).sortWithinPartitions(key, ts, order)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now = last = None
        tokens = most
        for batch in batches:
            said = []
            for k, t in zip(batch[key], batch[ts], strict=True):
                if now is None or k != now:
                    now, last, tokens = k, t, most
                tokens = min(most, tokens + (t - last) * rps)
                last = t
                said.append(tokens >= 1)
                tokens -= said[-1]
            batch["admitted"] = said
            yield batch

    return laid.mapInPandas(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in laid.schema.fields) + ", admitted boolean")


def rotate(addresses: Column, turn: Column) -> Column:
    """The list begun at place turn modulo its length, so that requests go round."""
    n = F.size(addresses)
    first = F.pmod(turn.cast("int"), F.greatest(n, F.lit(1)))
    return F.when(n < 2, addresses).otherwise(F.concat(F.slice(addresses, first + 1, n), F.slice(addresses, F.lit(1), first)))


def is_ip(text: str) -> bool:
    """A literal IPv4 or IPv6 address, without zone or leading zeros."""
    try:
        return "%" not in text and bool(ipaddress.ip_address(text))
    except ValueError:
        return False


def ip_pools(channels: DataFrame) -> DataFrame:
    """(host, ips): valid addresses of the channels (base_url, ip_pool, proxy, position) without a proxy, merged by host in order, each once."""

    @F.pandas_udf("boolean")
    def valid(ips: pd.Series) -> pd.Series:
        return ips.map(is_ip)

    some = channels.where("ip_pool is not null and coalesce(proxy, '') = '' and coalesce(base_url, '') <> ''")
    host = F.lower(F.try_parse_url(F.col("base_url"), F.lit("HOST")))
    each = some.select(host.alias("host"), "position", F.posexplode("ip_pool").alias("k", "ip")).where("host is not null and ip is not null")
    first = each.where(valid("ip")).groupBy("host", "ip").agg(F.min(F.struct("position", "k")).alias("at"))
    return first.groupBy("host").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "ip"))), lambda x: x["ip"]).alias("ips"))


def model_stats(log: DataFrame, model: str = "model", ok: str = "ok", seconds: str = "seconds", order: str = "ts") -> DataFrame:
    """(model, n_ok, n_failed, rate, avg_seconds, last_fails): a summary of a request log; last_fails counts failures since the last success.

    Failures at the time of the last success aren't after it. Rows without an outcome count for the mean time alone.
    The log is folded by ranges of its order: a range's last failures count if no later one has a success, so nothing is joined
    and a model that has most of the log is folded by many tasks.
    """

    def fold(rows: pd.DataFrame, state: dict) -> None:
        for k, part in rows.groupby(plain(rows["_k"]), dropna=False, sort=False):
            k = None if pd.isna(k) else k
            good, bad = part["_ok"] == True, part["_ok"] == False  # noqa: E712  nulls are neither
            old = state.setdefault(k, [0, 0, 0.0, 0, 0])
            last = int(good.to_numpy().nonzero()[0][-1]) if good.any() else -1
            tail = int(bad.iloc[last + 1 :].sum()) + (0 if last >= 0 else old[4])
            state[k] = [old[0] + int(good.sum()), old[1] + int(bad.sum()), old[2] + float(part["_s"].sum()), old[3] + int(part["_s"].count()), tail]

    rows = log.select(F.col(model).cast("string").alias("_k"), F.col(ok).alias("_ok"), F.col(seconds).cast("double").alias("_s"), F.col(order).alias("_o"))
    names = ["good", "bad", "total", "timed", "tail"]
    parts = blocks(rows, "_k", [F.col("_o"), F.col("_ok")], fold, names, "good bigint, bad bigint, total double, timed bigint, tail bigint")
    each = parts.groupBy("_k").agg(*[F.sum(c).alias(c) for c in names[:4]], in_order(["good", "tail"]).alias("_b"))
    since = F.aggregate("_b", F.lit(0).cast("bigint"), lambda n, x: F.when(x["good"] > 0, x["tail"]).otherwise(n + x["tail"]))
    rate = F.coalesce(F.col("good") / F.nullif(F.col("good") + F.col("bad"), F.lit(0)), F.lit(1.0))
    return each.select(F.col("_k").cast(log.schema[model].dataType).alias(model), F.col("good").alias("n_ok"), F.col("bad").alias("n_failed"), rate.alias("rate"), (F.col("total") / F.nullif("timed", F.lit(0))).alias("avg_seconds"), since.alias("last_fails"))
