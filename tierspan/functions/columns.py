"""Derived columns: times, decoded codes, ids and label cleaning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierspan.plans.schema import GENDERS


def duration() -> Column:
    return F.col("end") - F.col("start")


def seconds(ms: Column) -> Column:
    return ms / 1000


def ms_truncated(s: Column) -> Column:
    """Seconds to milliseconds, towards zero."""
    return (s * 1000).cast("long")


def ms_half_even(s: Column) -> Column:
    """Seconds to milliseconds, halves to the even neighbour."""
    return F.rint(s * 1000).cast("long")


def middle(start: Column, end: Column) -> Column:
    return (start + end) / 2


def decode(code: Column, names: dict, default=None) -> Column:
    out = F.lit(default)
    for key, name in names.items():
        out = F.when(code == key, F.lit(name)).otherwise(out)
    return out


def encode(name: Column, names: dict, default: int = 9) -> Column:
    out = F.lit(default)
    for key, value in names.items():
        if value is not None:
            out = F.when(name == F.lit(value), F.lit(key)).otherwise(out)
    return out.cast("short")


def gender(code: Column) -> Column:
    """The name of a stored gender code, null where it isn't known."""
    out = F.lit(None).cast("string")
    for key, name in GENDERS.items():
        if name is not None:
            out = F.when(code == key, name).otherwise(out)
    return out


def tri_state(code: Column, computed: Column) -> Column:
    """A stored overlap code where it is decided, else what was computed."""
    return F.when(code == 0, F.lit(False)).when(code == 1, F.lit(True)).otherwise(computed)


def stable_id(*parts: Column) -> Column:
    """Eight bytes that depend on the parts alone, so plans that run again give the same ids."""
    return F.unhex(F.substring(F.sha2(F.concat_ws("\x1f", *[p.cast("string") for p in parts]), 256), 1, 16))


def collar(start: Column, end: Column, width: int, total: Column) -> tuple[Column, Column]:
    return F.greatest(start - width, F.lit(0)), F.least(end + width, total)


def present(df: DataFrame, names: list[str]) -> Column:
    """The names of the columns that hold a value."""
    return F.filter(F.array(*[F.when(F.col(n).isNotNull(), F.lit(n)) for n in names]), lambda x: x.isNotNull())


def clean_label(label: Column) -> Column:
    """A word label without markers: trimmed; `_` stays; a leading `!` stays; what cleaning would empty stays raw."""
    raw = F.trim(label)
    body = F.trim(F.regexp_replace(F.regexp_replace(raw, r"^!", ""), r"[.?,*]|\*[a-z]+", ""))
    cleaned = F.when(body == "", raw).otherwise(F.when(raw.startswith("!"), F.concat(F.lit("!"), body)).otherwise(body))
    return F.when(raw == "_", raw).otherwise(cleaned)


def audio_dialect(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -2)


def component(path: Column) -> Column:
    return F.substring_index(F.element_at(F.split(path, "/"), -3), "-", -1)


def clock_ms(clock: Column) -> Column:
    """hh:mm:ss.fraction to milliseconds."""
    part = lambda k: F.split_part(clock, F.lit(":"), F.lit(k)).cast("double")
    return ms_half_even(part(1) * 3600 + part(2) * 60 + part(3))


def speaker_rows(df: DataFrame, missing_age: int | None = 0) -> DataFrame:
    """Speakers from a table of ID, sex, birthYear and resRegion."""
    born = F.col("birthYear").try_cast("int")
    return df.select(
        F.col("ID").alias("name"),
        F.when(born.isNull(), F.lit(missing_age)).otherwise(2000 - born).cast("short").alias("age"),
        F.when(F.col("sex") == "sex1", 2).when(F.col("sex") == "sex2", 1).otherwise(9).cast("short").alias("gender_code"),
        F.when(F.col("ID").startswith("N"), "nl").when(F.col("ID").startswith("V"), "vl").alias("dialect"),
        F.col("resRegion").alias("region"),
    )
