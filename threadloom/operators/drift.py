"""Files whose layout drifts: a list of every change, and one table with one type per field."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.operators.trees import hierarchy, resolve_forest
from threadloom.session import Scratch

HAS_FIELD = 5  # a file has a field when at least one record in five carries it
RENAME_RATE = 0.6  # share of redelivered records in which the new field carries the old one's values
FILE = ["feed", "file_no"]
RECORD = [*FILE, "line_no"]


REPEATED_KEYS = "spark.sql.variant.allowDuplicateKeys"


def with_document(df: DataFrame, payload: str) -> DataFrame:
    """Adds ``__v``, the variant of a line that is a JSON object, and ``doc``, its map from key to variant; null for other lines.

    Of a repeated key the last value counts.  A byte-order mark before the object is skipped; text
    behind it makes the line no JSON object.  The setting for repeated keys is read while the plan
    is analysed and put back at once.
    """
    conf = df.sparkSession.conf
    before = conf.get(REPEATED_KEYS, "false")
    text = F.trim(F.col(payload), F.lit(" \t\r\n\ufeff"))
    conf.set(REPEATED_KEYS, "true")
    try:
        parsed = df.withColumn("__v", F.when(text.startswith("{") & text.endswith("}"), F.try_parse_json(text)))
    finally:
        conf.set(REPEATED_KEYS, before)
    return parsed.withColumn("doc", F.expr("cast(__v as map<string, variant>)"))


def read_records(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Lines that are JSON objects, with ``doc`` as map from key to variant; other lines are left out."""
    return with_document(df, payload).where(F.col("__v").isNotNull()).drop("__v")


def value_kind(schema: Column) -> Column:
    """JSON type of a value from its variant schema; null for a JSON null."""
    return (
        F.when(schema.startswith("OBJECT"), "object").when(schema.startswith("ARRAY"), "array").when(schema == "STRING", "string").when(schema == "BOOLEAN", "boolean")
        .when(schema.isin("BIGINT", "INT", "SMALLINT", "TINYINT"), "integer").when(schema.startswith("DECIMAL") | schema.isin("DOUBLE", "FLOAT"), "decimal")
    )


def file_layouts(records: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(fields of each file with their type, files with their successor).

    Every record emits its keys and one entry without a key, so a single pass counts both.  Counting is
    merged map-side, so one file or feed may hold any share of the rows.
    """
    itself = F.expr("array(struct(cast(null as string) as key, cast(null as variant) as value))")
    entries = records.select(*FILE, F.explode(F.concat(F.map_entries("doc"), itself)).alias("e"))
    cells = entries.select(*FILE, F.col("e.key").alias("field"), value_kind(F.expr("schema_of_variant(e.value)")).alias("kind"))
    counts = scratch.save(cells.groupBy(*FILE, "field", "kind").agg(F.count(F.lit(1)).alias("n")), "counts")
    files = counts.where(F.col("field").isNull()).select(*FILE, F.col("n").alias("n_records"))
    files = files.withColumn("next_file", F.lead("file_no").over(Window.partitionBy("feed").orderBy("file_no")))
    kind = F.max_by(F.when(F.col("kind").isNotNull(), F.col("kind")), F.struct(F.col("kind").isNotNull(), "n", "kind"))
    fields = counts.where(F.col("field").isNotNull()).groupBy(*FILE, "field").agg(F.sum("n").alias("carriers"), kind.alias("kind"))
    layout = fields.join(files, FILE).where(F.col("carriers") * HAS_FIELD >= F.col("n_records"))
    return layout.select(*FILE, "field", "kind", "next_file"), files


def raw_changes(layout: DataFrame, files: DataFrame) -> DataFrame:
    """``feed, file_no, field, change, old_kind, new_kind`` before renames are known."""
    before = layout.where(F.col("next_file").isNotNull()).select("feed", F.col("next_file").alias("file_no"), "field", F.col("kind").alias("old_kind"), F.lit(True).alias("was"))
    after = layout.select(*FILE, "field", F.col("kind").alias("new_kind"), F.lit(True).alias("is"))
    both = after.join(before, [*FILE, "field"], "full")
    later = files.where(F.col("next_file").isNotNull()).select("feed", F.col("next_file").alias("file_no"))
    change = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "removed").when(F.col("old_kind") != F.col("new_kind"), "retyped")
    return both.join(later, FILE, "left_semi").select(*FILE, "field", change.alias("change"), "old_kind", "new_kind").where(F.col("change").isNotNull())


def with_leaves(df: DataFrame) -> DataFrame:
    """Adds ``leaves``: hashes of the scalars inside the variant ``value``, each in one notation whatever its form.

    Numbers and numeric text are equal; times in seconds, milliseconds, microseconds or ISO text are
    whole epoch seconds; text is lower case without a leading ``r/``, ``u/`` or ``t3_``-like mark.
    Only objects and arrays are taken apart as text.  A scalar goes through one column per step, so
    that no step is evaluated again for each use of it.
    """
    columns = df.columns
    rows = df.withColumn("__text", F.trim(F.try_variant_get("value", "$", "string")))
    kind = F.schema_of_variant("value")
    opens = F.col("__text").startswith("{") | F.col("__text").startswith("[")
    rows = rows.withColumn("__nested", opens & (kind.startswith("OBJECT") | kind.startswith("ARRAY")))
    text = F.col("__text")
    rows = rows.withColumns({"__digits": starts_number(text), "__low": F.lower(text)})
    rows = rows.withColumn("__whole", F.when(F.col("__digits") & ~F.col("__nested"), plain_number(text)))
    rows = rows.withColumn("__own", hashed(F.col("__whole"), F.col("__low")))
    tokens = F.regexp_extract_all(F.to_json("value"), F.lit(r'"(?:[^"\\]|\\.)*"\s*:|"(?:[^"\\]|\\.)*"|-?\d[\d.eE+-]*|true|false'), F.lit(0))
    parts = F.transform(F.filter(tokens, lambda t: ~t.endswith(":")), lambda t: canonical(F.regexp_replace(t, r'^"|"$', "")))
    inside = F.array_distinct(F.filter(parts, lambda x: x.isNotNull()))
    leaves = F.when(F.col("__nested"), inside).when(F.col("__own").isNotNull(), F.array("__own")).otherwise(F.array().cast("array<bigint>"))
    return rows.select(*columns, leaves.alias("leaves"))


def starts_number(text: Column) -> Column:
    return F.substring(text, 1, 1).between("0", "9") | text.startswith("-")


def plain_number(text: Column) -> Column:
    """The number or time that a text is, as seconds where it is a time; the patterns run only on text that begins like theirs."""
    number = F.when(text.rlike(r"^-?\d[\d.eE+-]*$"), text.try_cast("double"))
    dated = (F.length(text) >= 16) & (F.substring(text, 5, 1) == "-") & text.rlike(r"^\d{4}-\d\d-\d\d[T ]\d\d:\d\d")
    moment = F.when(dated, F.unix_timestamp(F.try_to_timestamp(text)).cast("double"))
    seconds = lambda x: F.when(F.abs(x) >= 1e14, x / 1e6).when(F.abs(x) >= 1e11, x / 1e3).otherwise(x)
    cut = lambda x: F.when(F.abs(x) >= 1e8, F.floor(x).cast("double")).otherwise(x)
    return F.coalesce(moment, cut(seconds(number)))


def hashed(whole: Column, low: Column) -> Column:
    marked = (F.substring(low, 2, 1) == "/") | (F.substring(low, 3, 1) == "_")
    plain = F.when(marked, F.regexp_replace(low, r"^(?:[ru]/|t\d_)", "")).otherwise(low)
    return F.when(whole.isNotNull(), F.xxhash64(F.lit(1), whole)).when(plain != "", F.xxhash64(F.lit(2), plain))


def canonical(text: Column) -> Column:
    """Hash of a scalar in its one notation; null for null and empty text."""
    text = F.trim(text)
    return hashed(F.when(starts_number(text), plain_number(text)), F.lower(text))


def renames(records: DataFrame, changes: DataFrame, files: DataFrame, scratch: Scratch) -> DataFrame:
    """``feed, file_no, old_field, new_field, support, rate`` of fields that live on under a new name.

    Only files in which a field went and another came are looked at.  A record of the earlier file
    and one of the later are the same when they share at least two scalars that occur in exactly one
    record of either file; no key needs to be known for that, so the identifier itself may change
    its name.  Every join runs on values that are unique in their file, so no pairs multiply.
    """
    gone = changes.where(F.col("change") == "removed").select(*FILE, F.col("field").alias("old_field"))
    came = changes.where(F.col("change") == "added").select(*FILE, F.col("field").alias("new_field"))
    pairs = gone.join(came, FILE)
    wanted = pairs.select(*FILE).distinct()
    previous = files.where(F.col("next_file").isNotNull()).select("feed", "file_no", "next_file")
    touched = wanted.unionByName(previous.join(wanted.withColumnRenamed("file_no", "next_file"), ["feed", "next_file"], "left_semi").select(*FILE)).distinct()
    touched = scratch.save(touched, "touched")  # one row per file; its size is known when the join is planned
    looked_at = records.join(touched, FILE, "left_semi").select(*RECORD, F.explode("doc").alias("field", "value"))
    # filtered when read: a filter before would be moved under the steps and run them twice
    cells = scratch.save(with_leaves(looked_at).select(*RECORD, "field", "leaves"), "cells").where(F.size("leaves") > 0)
    later = cells.join(wanted, FILE, "left_semi")
    earlier = cells.join(previous, FILE).drop("file_no").withColumnRenamed("next_file", "file_no").join(wanted, FILE, "left_semi")

    def unique(side: DataFrame, name: str) -> DataFrame:
        rows = side.select(*FILE, "line_no", F.explode("leaves").alias("leaf"))
        one = rows.groupBy(*FILE, "leaf").agg(F.min("line_no").alias(name), F.max("line_no").alias("last"))
        return one.where(F.col(name) == F.col("last")).select(*FILE, "leaf", name)

    shared = unique(earlier, "old_line").join(unique(later, "new_line"), [*FILE, "leaf"])
    links = shared.groupBy(*FILE, "old_line", "new_line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= 2).drop("n")
    old = earlier.join(gone.withColumnRenamed("old_field", "field"), [*FILE, "field"], "left_semi")
    old = old.select(*FILE, F.col("line_no").alias("old_line"), F.col("field").alias("old_field"), F.col("leaves").alias("old_leaves"))
    new = later.join(came.withColumnRenamed("new_field", "field"), [*FILE, "field"], "left_semi")
    new = new.select(*FILE, F.col("line_no").alias("new_line"), F.col("field").alias("new_field"), F.col("leaves").alias("new_leaves"))
    compared = links.join(old, [*FILE, "old_line"]).join(new, [*FILE, "new_line"])
    same = F.arrays_overlap("old_leaves", "new_leaves").cast("int")
    scored = compared.groupBy(*FILE, "old_field", "new_field").agg(F.count(F.lit(1)).alias("support"), F.avg(same).alias("rate"))
    scored = scored.where(F.col("rate") >= RENAME_RATE)
    order = [F.desc("rate"), F.desc("support")]
    best_new = F.row_number().over(Window.partitionBy(*FILE, "old_field").orderBy(*order, "new_field"))
    best_old = F.row_number().over(Window.partitionBy(*FILE, "new_field").orderBy(*order, "old_field"))
    return scored.withColumn("a", best_new).withColumn("b", best_old).where("a = 1 and b = 1").drop("a", "b")


def survey_layouts(df: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(records, layout, files, changes); the last three are small and written once."""
    scratch = Scratch(df.sparkSession)
    records = read_records(df)
    layout, files = file_layouts(records, scratch)
    layout, files = scratch.save(layout, "layout"), scratch.save(files, "files")
    return records, layout, files, scratch.save(all_changes(records, layout, files, scratch), "changes")


def layout_changes(df: DataFrame) -> DataFrame:
    """``feed, file_no, field, change, old_field, old_kind, new_kind`` for each change between neighbouring files.

    ``change`` is added, removed, renamed or retyped; a renamed field whose type differs too has two
    rows.  ``field`` is the name in the later file, for removed that in the earlier one.  Empty
    tables and single files give no rows.
    """
    return survey_layouts(df)[3]


def all_changes(records: DataFrame, layout: DataFrame, files: DataFrame, scratch: Scratch) -> DataFrame:
    changes = scratch.save(raw_changes(layout, files), "raw")
    moved = renames(records, changes, files, scratch).select(*FILE, "old_field", "new_field")
    kinds_old = changes.where(F.col("change") == "removed").select(*FILE, F.col("field").alias("old_field"), "old_kind")
    kinds_new = changes.where(F.col("change") == "added").select(*FILE, F.col("field").alias("new_field"), "new_kind")
    moved = moved.join(kinds_old, [*FILE, "old_field"]).join(kinds_new, [*FILE, "new_field"])
    stays = changes.join(moved.select(*FILE, F.col("new_field").alias("field"), F.lit("added").alias("change")), [*FILE, "field", "change"], "left_anti")
    stays = stays.join(moved.select(*FILE, F.col("old_field").alias("field"), F.lit("removed").alias("change")), [*FILE, "field", "change"], "left_anti")
    out = [*FILE, "field", "change", "old_field", "old_kind", "new_kind"]
    renamed = moved.withColumn("change", F.explode(F.array(F.lit("renamed"), F.when(F.col("old_kind") != F.col("new_kind"), "retyped")))).where(F.col("change").isNotNull())
    renamed = renamed.withColumnRenamed("new_field", "field").select(*out)
    return stays.withColumn("old_field", F.when(F.col("change") != "added", F.col("field"))).select(*out).unionByName(renamed)


# The target schema: column, type and the members of an object that may hold the value.
TARGETS = {"submission_id": "string", "subreddit": "string", "author": "string", "created_utc": "epoch", "score": "double", "title": "string", "selftext": "string"}
PROMOTED = {"num_comments": "long", "flair": "string", "edited": "string"}
INSIDE = ("$.name", "$.raw", "$.value", "$[0].name", "$[0].raw", "$[0]")


def scalar_text(value: Column) -> Column:
    """Text of a scalar variant; of an object or array that of the member that holds its value."""
    kind = value_kind(F.schema_of_variant(value))
    inner = F.coalesce(*[F.try_variant_get(value, path, "string") for path in INSIDE])
    return F.when(kind.isin("object", "array"), inner).otherwise(F.try_variant_get(value, "$", "string"))


def typed(value: Column, kind: str) -> Column:
    """The variant in the target type, null where it cannot be cast; times become epoch seconds."""
    text = F.trim(scalar_text(value))
    if kind == "string":
        return text
    number = text.try_cast("double")
    if kind != "epoch":
        return number.try_cast(kind)
    seconds = F.when(F.abs(number) >= 1e14, number / 1e6).when(F.abs(number) >= 1e11, number / 1e3).otherwise(number)
    return F.coalesce(F.floor(seconds).try_cast("long"), F.unix_timestamp(F.try_to_timestamp(text)))


def squeezed(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), "[^a-z0-9]", "")


def field_targets(layout: DataFrame, files: DataFrame, changes: DataFrame, targets: Mapping[str, str]) -> DataFrame:
    """``feed, file_no, target, field``: which field of a file fills which column.

    A field's earliest name in its feed is found by pointer doubling over the files; that name, or
    else the field's own, is matched with the targets without regard to case and separators.
    """
    mark = F.lit("\x1f")
    key = lambda file, field: F.concat_ws("\x1f", "feed", file, field)
    before = files.where(F.col("next_file").isNotNull()).select("feed", F.col("file_no").alias("prev_file"), F.col("next_file").alias("file_no"))
    moved = changes.where(F.col("change") == "renamed").select(*FILE, "field", "old_field")
    stayed = layout.select("feed", F.col("file_no").alias("prev_file"), "field", F.lit(True).alias("stayed"))
    rows = layout.select(*FILE, "field").join(before, FILE, "left").join(moved, [*FILE, "field"], "left").join(stayed, ["feed", "prev_file", "field"], "left")
    up = F.when(F.col("old_field").isNotNull(), key("prev_file", "old_field")).when(F.col("stayed"), key("prev_file", "field"))
    nodes = rows.select(key("file_no", "field").alias("id"), up.alias("ptr"), F.when(up.isNull(), F.col("field")).alias("root"))
    named = hierarchy(resolve_forest(nodes), paths=False).select("id", "root")
    parts = F.split("id", mark)
    names = named.select(parts[0].alias("feed"), parts[1].cast("int").alias("file_no"), parts[2].alias("field"), "root")
    known = F.create_map(*[F.lit(x) for t in targets for x in (t.replace("_", ""), t)])
    target = F.coalesce(F.try_element_at(known, squeezed(F.col("root"))), F.try_element_at(known, squeezed(F.col("field"))))
    best = names.select(*FILE, "field", target.alias("target")).where(F.col("target").isNotNull())
    return best.groupBy(*FILE, "target").agg(F.min("field").alias("field"))


def rescue_ingest(df: DataFrame, payload: str = "payload", targets: Mapping[str, str] = TARGETS) -> DataFrame:
    """Every line in one typed table: file columns, the targets, ``rescued`` and ``corrupt``.

    ``rescued`` is a JSON object of all fields that fill no column, cannot be cast, or hold more than
    the scalar that was taken from them.  Lines that are no JSON object keep their text in
    ``corrupt`` and have nulls elsewhere.  A line that deviates from its file is read by the names its
    feed uses in any file.
    """
    _, layout, files, changes = survey_layouts(df)
    fields = Scratch(df.sparkSession).save(field_targets(layout, files, changes, targets), "targets")
    here = fields.groupBy(*FILE).agg(F.map_from_entries(F.collect_list(F.struct("target", "field"))).alias("here"))
    ever = fields.groupBy("feed", "target").agg(F.sort_array(F.collect_set("field")).alias("names"))
    ever = ever.groupBy("feed").agg(F.map_from_entries(F.collect_list(F.struct("target", "names"))).alias("ever"))
    lines = with_document(df, payload)
    rows = lines.join(here, FILE, "left").join(ever, "feed", "left")
    keys = {}
    for target in targets:
        own = F.array(F.try_element_at("here", F.lit(target)))
        names = F.concat(own, F.coalesce(F.try_element_at("ever", F.lit(target)), F.array().cast("array<string>")), F.array(F.lit(target)))
        keys[target] = F.try_element_at(F.filter(names, lambda k: k.isNotNull() & F.coalesce(F.map_contains_key("doc", k), F.lit(False))), F.lit(1))
    rows = rows.select(*RECORD, payload, "__v", "doc", *[k.alias(f"__k_{t}") for t, k in keys.items()])
    rows = rows.select("*", *[typed(F.try_element_at("doc", F.col(f"__k_{t}")), kind).alias(t) for t, kind in targets.items()])
    whole = [F.when(F.col(t).isNotNull() & ~F.coalesce(value_kind(F.schema_of_variant(F.try_element_at("doc", F.col(f"__k_{t}")))), F.lit("")).isin("object", "array"), F.col(f"__k_{t}")) for t in targets]
    used = F.filter(F.array(*whole), lambda k: k.isNotNull())
    rest = F.map_filter("doc", lambda k, v: ~F.array_contains(used, k))
    return rows.select(*RECORD, *targets, F.when(F.size(rest) > 0, F.to_json(rest)).alias("rescued"), F.when(F.col("__v").isNull(), F.col(payload)).alias("corrupt"))


def replay(table: DataFrame, promoted: Mapping[str, str] = PROMOTED) -> DataFrame:
    """Promotes approved fields: their rescued values move into typed columns of their own.

    A value that cannot be cast stays in ``rescued`` and its column is null.
    """
    doc = F.expr("cast(try_parse_json(rescued) as map<string, variant>)")
    rows = table.withColumn("__doc", doc)
    rows = rows.select("*", *[typed(F.try_element_at("__doc", F.lit(f)), kind).alias(f) for f, kind in promoted.items()])
    taken = F.filter(F.array(*[F.when(F.col(f).isNotNull(), F.lit(f)) for f in promoted]), lambda k: k.isNotNull())
    rest = F.map_filter("__doc", lambda k, v: ~F.array_contains(taken, k))
    columns = [c for c in table.columns if c not in ("rescued", "corrupt")]
    return rows.select(*columns, *promoted, F.when(F.size(rest) > 0, F.to_json(rest)).alias("rescued"), "corrupt")
