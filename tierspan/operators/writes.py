"""Insert, replace, delete and merge policies, and the checks before them. Each returns frames; a corpus commits them together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


class Rejected(ValueError):
    """A check before writing found rows that break a rule; nothing was written."""


def require_empty(violations: DataFrame, what: str) -> None:
    found = violations.take(5)
    if found:
        raise Rejected(f"{what}: {[r.asDict() for r in found]}")


def duplicate_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).count().where("count > 1")


def existing(rows: DataFrame, old: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(old.select(*keys).distinct(), keys, "left_semi")


def new(rows: DataFrame, old: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(old.select(*keys).distinct(), keys, "left_anti")


def insert(old: DataFrame, rows: DataFrame, keys: list[str], *, overwrite: bool = False) -> DataFrame:
    """All rows or none: a key that is there already is an error, or is replaced."""
    require_empty(duplicate_keys(rows, keys), "keys occur twice in the batch")
    if not overwrite:
        require_empty(existing(rows.select(*keys), old, keys), "keys exist already")
        return old.unionByName(rows)
    return new(old, rows, keys).unionByName(rows)


def insert_gracefully(old: DataFrame, rows: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(the table with what could be inserted, the rows that were left out): of several rows of one key none is inserted, as which to keep isn't known."""
    twice = duplicate_keys(rows, keys).select(*keys)
    fit = rows.join(twice, keys, "left_anti")
    fit = new(fit, old, keys)
    return old.unionByName(fit), rows.join(fit.select(*keys), keys, "left_anti")


def link_speakers(links: DataFrame, added: DataFrame) -> DataFrame:
    """Pairs of a speaker and an audio, each once, with those of `added`."""
    return links.unionByName(added.select(*links.columns)).distinct()


def unlink_speakers(links: DataFrame, gone: DataFrame) -> DataFrame:
    """The pairs without those in `gone`."""
    return links.join(gone.select("speaker_id", "audio_id").distinct(), ["speaker_id", "audio_id"], "left_anti").select(*links.columns)


def append(old: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    return old.unionByName(rows)


def append_new(old: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """As `append`, but a row that is stored already, column for column, isn't added again: it counts once for each time it is stored.

    Only stored rows whose keys the new ones have are compared.
    """
    asked = rows.select(*[F.col(k).alias(f"_k{n}") for n, k in enumerate(keys)]).distinct()
    same = F.lit(True)
    for n, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{n}"))
    return old.unionByName(rows.select(*old.columns).exceptAll(old.join(asked, same, "left_semi")))


def add_missing(old: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    require_empty(duplicate_keys(old.join(rows.select(*keys).distinct(), keys, "left_semi"), keys), "several rows match")
    return old.unionByName(new(rows, old, keys))


def replace(old: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Each row must match exactly one old row, which it replaces."""
    require_empty(new(rows, old, keys).select(*keys), "no row to replace")
    require_empty(duplicate_keys(existing(old, rows, keys), keys), "several rows match")
    return new(old, rows, keys).unionByName(rows)


def upsert(old: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    require_empty(duplicate_keys(existing(old, rows, keys), keys), "several rows match")
    return new(old, rows, keys).unionByName(rows)


def delete(old: DataFrame, gone: DataFrame, keys: list[str], *, missing_ok: bool = True) -> DataFrame:
    """Rows whose key isn't to go; a key that isn't there is an error unless it may be missing."""
    if not missing_ok:
        require_empty(new(gone.select(*keys).distinct(), old, keys), "no row to delete")
    return new(old, gone, keys)


def rekey(tables: dict[str, DataFrame], level: str, renamed: DataFrame) -> dict[str, DataFrame]:
    """Tables after rows (old, new) gave rows of a level other ids: what refers to them follows. All renamed or none."""
    refers = {"audios": "audio_id", "speakers": "speaker_id", "phrases": "phrase_id"}
    levels = ["phrases", "words", "syllables", "phones"]
    ids = tables[level].select(F.col("identifier").alias("id"))
    require_empty(duplicate_keys(renamed, ["old"]), "an id is renamed twice")
    require_empty(duplicate_keys(renamed, ["new"]), "two ids become one")
    require_empty(new(renamed.select(F.col("old").alias("id")), ids, ["id"]), "no row to rename")
    stay = new(ids, renamed.select(F.col("old").alias("id")), ["id"])
    require_empty(existing(renamed.select(F.col("new").alias("id")), stay, ["id"]), "the new id is taken")

    def follow(df: DataFrame, column: str) -> DataFrame:
        to = renamed.select(F.col("old").alias("_old"), F.col("new").alias("_new"))
        return df.join(to, F.col(column) == F.col("_old"), "left").withColumn(column, F.coalesce("_new", column)).drop("_old", "_new")

    out = {level: follow(tables[level], "identifier")}
    for name, df in tables.items():
        changed = out.get(name, df)
        columns = [c for c in [refers.get(level)] if c in df.columns]
        if level in levels[:-1] and name == levels[levels.index(level) + 1] and "parent_id" in df.columns:
            columns.append("parent_id")
        for column in columns:
            changed = follow(changed, column)
        if columns or name == level:
            out[name] = changed.select(*df.columns)
    return out


def delete_phrases(tables: dict[str, DataFrame], phrases: DataFrame) -> dict[str, DataFrame]:
    """The four levels without some phrases and what hangs on them."""
    gone = phrases.select(F.col("identifier").alias("_gone")).distinct()
    own = {"phrases": "identifier", "words": "parent_id", "syllables": "phrase_id", "phones": "phrase_id"}
    return {name: tables[name].join(gone, F.col(key) == F.col("_gone"), "left_anti") for name, key in own.items()}


def same_identity(old: DataFrame, rows: DataFrame) -> None:
    """Rows whose id is stored already keep their audio and speaker."""
    was = old.select(F.col("identifier").alias("_id"), F.col("audio_id").alias("_a"), F.col("speaker_id").alias("_s"))
    odd = rows.join(was, F.col("identifier") == F.col("_id")).where(~F.col("audio_id").eqNullSafe(F.col("_a")) | ~F.col("speaker_id").eqNullSafe(F.col("_s")))
    require_empty(odd.select("identifier"), "audio and speaker can't change once stored")


def replace_trees(tables: dict[str, DataFrame], staged: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Phrases with all below them, replaced by staged ones; all checks are one job over the staged rows."""
    require_none(tree_violations(staged, tables))
    rest = delete_phrases(tables, staged["phrases"])
    return {name: rest[name].unionByName(staged[name]) for name in rest}


#: What hangs on a phrase, and the column that names it.
OWNERS = {"words": "parent_id", "syllables": "phrase_id", "phones": "phrase_id"}


def violations_of(rows: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """(kind, sample): each check that a row fails, with the row's id."""
    ident = F.hex("identifier") if isinstance(rows.schema["identifier"].dataType, T.BinaryType) else F.col("identifier").cast("string")
    return rows.select(F.explode(F.filter(F.array(*[F.when(failed, F.lit(kind)) for kind, failed in checks.items()]), lambda k: k.isNotNull())).alias("kind"), ident.alias("sample"))


def _identities(rows: DataFrame, old: DataFrame | None) -> tuple[DataFrame, Column]:
    """`rows` beside what is stored under their ids, and whether their audio or speaker differs from it."""
    if old is None:
        return rows, F.lit(False)
    was = old.select(F.col("identifier").alias("_id"), F.col("audio_id").alias("_was_a"), F.col("speaker_id").alias("_was_s"))
    return rows.join(was, F.col("identifier") == F.col("_id"), "left"), F.col("_id").isNotNull() & ~(F.col("audio_id").eqNullSafe(F.col("_was_a")) & F.col("speaker_id").eqNullSafe(F.col("_was_s")))


def tree_violations(staged: dict[str, DataFrame], stored: dict[str, DataFrame] | None = None) -> DataFrame:
    """(kind, sample) of all that is wrong with phrases and what hangs on them, from one pass over each staged table.

    Ids and times are there, ids and phrases occur once, phrases of one speaker don't overlap, and what hangs on a phrase has its audio
    and speaker. With `stored`, staged phrases don't overlap those that stay either, and ids that are stored keep their audio and speaker.
    """
    lacking = [name for name in ("phrases", *OWNERS) if name not in staged]
    if lacking or "parent_id" in staged["phrases"].columns:
        raise Rejected(f"trees need {', '.join(lacking)}" if lacking else "the items of a batch of trees must be phrases, which have no parents")
    twice = F.count(F.when(F.col("_staged"), 1)).over(Window.partitionBy("identifier")) > 1
    absent = lambda columns: F.array_contains(F.array(*[F.col(c).isNull() for c in columns]), True)

    base = ["identifier", "audio_id", "speaker_id", "start", "end"]
    phrases, changed = _identities(staged["phrases"].select(*base), stored and stored["phrases"])
    phrases = phrases.withColumn("_changed", changed).select(*base, "_changed", F.lit(True).alias("_staged"))
    if stored:
        ours = staged["phrases"].select("audio_id", "speaker_id").distinct()
        stay = stored["phrases"].join(staged["phrases"].select("identifier"), "identifier", "left_anti").join(ours, ["audio_id", "speaker_id"], "left_semi")
        phrases = phrases.unionByName(stay.select(*base, F.lit(False).alias("_changed"), F.lit(False).alias("_staged")))
    said = Window.partitionBy("audio_id", "speaker_id")
    before = said.orderBy("start", "end", "identifier").rowsBetween(Window.unboundedPreceding, -1)
    new = F.col("_staged")
    clash = new & (F.col("start") < F.max("end").over(before)) | (F.col("start") < F.max(F.when(new, F.col("end"))).over(before))
    again = F.count(F.when(new, 1)).over(Window.partitionBy("audio_id", "speaker_id", "start")) > 1
    flagged = phrases.withColumns({"_twice": new & twice, "_clash": clash, "_again": new & again})
    out = violations_of(flagged, {"phrases without id, audio or times": new & absent(["identifier", "audio_id", "start", "end"]), "ids of phrases occur twice": F.col("_twice"), "phrases occur twice": F.col("_again"), "phrases of one speaker overlap": F.col("_clash"), "audio and speaker can't change once stored": F.col("_changed")})

    owner = staged["phrases"].select(F.col("identifier").alias("_p"), F.col("audio_id").alias("_a"), F.col("speaker_id").alias("_s")).dropDuplicates(["_p"])
    for name, key in OWNERS.items():
        # ids are counted by themselves and owners kept in hash tables, as whole rows would be sorted for either
        ids = staged[name].groupBy("identifier").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
        out = out.unionByName(violations_of(ids.select("identifier", F.explode(F.sequence(F.lit(1), F.col("_n")))), {f"ids of {name} occur twice": F.lit(True)}))
        rows, changed = _identities(staged[name].select(*base, F.col(key).alias("_owner")), stored and stored[name])
        rows = rows.withColumn("_changed", changed).join(owner.hint("shuffle_hash"), F.col("_owner") == F.col("_p"), "left")
        differs = F.col("_p").isNotNull() & ~(F.col("audio_id").eqNullSafe(F.col("_a")) & F.col("speaker_id").eqNullSafe(F.col("_s")))
        out = out.unionByName(violations_of(rows, {f"{name} without id, audio, times or {key}": absent(["identifier", "audio_id", "start", "end", "_owner"]), f"{name} and their phrase differ in speaker or audio": differs, "audio and speaker can't change once stored": F.col("_changed")}))
    return out


def require_none(violations: DataFrame) -> None:
    """One job: every kind of violation with its count and its first row."""
    found = violations.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.min("sample").alias("first")).collect()
    if found:
        raise Rejected("; ".join(f"{r['kind']}: {r['n']}, first {r['first']}" for r in sorted(found, key=lambda r: r["kind"])))


def validate_trees(staged: dict[str, DataFrame]) -> None:
    require_none(tree_violations(staged))


def multiset_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that one side has more often than the other, with `side`."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def report(issues: DataFrame, kind: str, sample: str, most: int = 20) -> DataFrame:
    """(kind, n, samples): counts, and the first few samples of each kind; samples are cut down before they are gathered."""
    counts = issues.groupBy(kind).agg(F.count(F.lit(1)).alias("n"))
    distinct = issues.select(kind, sample).distinct()
    few = distinct.withColumn("_r", F.row_number().over(Window.partitionBy(kind).orderBy(sample))).where(F.col("_r") <= most)
    return counts.join(few.groupBy(kind).agg(F.array_sort(F.collect_list(sample)).alias("samples")), kind)
