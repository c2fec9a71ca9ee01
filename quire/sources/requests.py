"""Requests to services as columns: addresses, cache keys, limits, and which answers may be kept."""

from __future__ import annotations

from urllib.parse import quote

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

# Requests and seconds of each service's window
LIMITS = {"library": (20, 1), "calendar": (80, 10), "statutes": (10, 1), "register": (5, 1)}
#: Seconds that an answer lives after it was written, and most polls of an unfinished task.
LIFETIME, MOST_POLLS = 86_400, 15


def limit_table(spark) -> DataFrame:
    """(service, requests, seconds)."""
    schema = StructType([StructField("service", StringType()), StructField("requests", IntegerType()), StructField("seconds", IntegerType())])
    return spark.createDataFrame([(s, n, t) for s, (n, t) in LIMITS.items()], schema)


def address(base: str, params: dict) -> str:
    """An address with its parameters: lists repeat, booleans are 1 or 0, those without a value go."""
    if not base.startswith(("http://", "https://")):
        raise ValueError(f"not a web address: {base}")
    plain = lambda v: str(int(v)) if isinstance(v, bool) else str(v)
    pairs = [(k, plain(x)) for k, v in params.items() if v is not None for x in (v if isinstance(v, list | tuple) else [v])]
    return base + ("?" + "&".join(f"{quote(k)}={quote(v)}" for k, v in pairs) if pairs else "")


def cache_key(url: Column, body: Column | None = None) -> Column:
    """The name an answer is kept under: a digest of the address, or of address and body."""
    return F.left(F.sha2(url if body is None else F.concat_ws("::", url, body), 256), F.lit(32))


def is_error(payload: Column) -> Column:
    """Whether an answer reports a failure; such answers are not kept."""
    error = F.get_json_object(payload, "$.error")
    return error.isNotNull() & ~error.isin("", "false", "0", "null", "[]", "{}")


def usable(answers: DataFrame, now: Column, disabled: bool = False) -> DataFrame:
    """Kept answers (key, written, payload) that are a hit: whole JSON, no failure, ``LIFETIME`` seconds old at most."""
    whole = F.try_parse_json("payload").isNotNull() & ~is_error(F.col("payload"))
    age = now.cast("timestamp").cast("double") - F.col("written").cast("double")
    return answers.where(whole & (age <= LIFETIME) & F.lit(not disabled))


def bounded(limit: int) -> int:
    """A limit that a user states: from 1 to 100."""
    if not 1 <= limit <= 100:
        raise ValueError("a limit lies between 1 and 100")
    return limit


def checked(params: dict, catalogue: dict[str, list[str] | None]) -> dict:
    """Parameters that a service's catalogue knows, values among those it lists; others are refused."""
    for name, value in params.items():
        if name not in catalogue:
            raise ValueError(f"unknown parameter {name!r}; there are {', '.join(sorted(catalogue))}")
        if catalogue[name] and value not in catalogue[name]:
            raise ValueError(f"{name!r} takes {', '.join(catalogue[name])}")
    return params


def polled(states: DataFrame) -> DataFrame:
    """(task, payload, polls): the first finished answer of each task among its first ``MOST_POLLS`` polls; null where there is none."""
    done = F.col("state") == "SUCCESS"
    first = states.where(F.col("poll") <= MOST_POLLS).groupBy("task").agg(F.min_by(F.when(done, F.col("payload")), F.when(done, F.col("poll"))).alias("payload"), F.min(F.when(done, F.col("poll"))).alias("polls"))
    return first


