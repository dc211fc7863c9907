"""Problem 3: nested iteration records into flat tables that keep parent and ordinal.

Typed rows and raw JSON lines are brought to one merged schema, VARIANT, in which a field may
be an array in one record, a single object or JSON inside a text in the next. Every array
level is exploded into a child table whose key is the parent's path plus the ordinal; the
trajectories inside sub-calls are the next level, until a level is empty."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanforge.session import durable, spread

ID = ("run_id", "iteration")


def _array(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def _get(v: Column, field: str) -> Column:
    return F.try_variant_get(v, f"$.{field}", "variant")


def unwrapped(df: DataFrame, source: str, target: str) -> DataFrame:
    """target: source, or what is written in it if it is a text that holds a JSON array or object.

    Steps are columns of their own, so that each is computed once."""
    scalar = _array(F.col(source)).isNull() & F.try_variant_get(source, "$", "map<string,variant>").isNull()
    text = F.when(scalar, F.try_variant_get(source, "$", "string"))
    return (
        df.withColumn("_text", text)
        .withColumn(target, F.coalesce(F.when(F.col("_text").rlike(r"^\s*[\[{]"), F.try_parse_json("_text")), F.col(source)))
        .drop("_text")
    )


def records(df: DataFrame, source: str, target: str) -> DataFrame:
    """target: array<variant>, the array itself or the one record that was written without an array; never null."""
    one = F.when(F.col("_w").isNull() | F.is_variant_null("_w"), F.array().cast("array<variant>")).otherwise(F.array("_w"))
    df = unwrapped(df, source, "_w").withColumn("_a", _array(F.col("_w")))
    return df.withColumn(target, F.coalesce("_a", one)).drop("_w", "_a")


def _slots(kind: str, array: str) -> Column:
    """The slots of an array with kind and ordinal; null slots count in the ordinal and are left out."""
    slots = F.transform(
        F.col(array), lambda x, i: F.struct(F.lit(kind).alias("kind"), i.cast("bigint").alias("ordinal"), x.alias("slot"))
    )
    return F.filter(slots, lambda s: s["slot"].isNotNull() & ~F.is_variant_null(s["slot"]))


def _path(prefix: Column, kind: Column, ordinal: Column) -> Column:
    return F.concat(prefix, kind, ordinal.cast("string"))


def typed_roots(iterations: DataFrame) -> DataFrame:
    return iterations.select(
        "run_id",
        F.col("iteration").cast("bigint").alias("iteration"),
        F.lit("").alias("record_path"),
        F.to_variant_object(F.struct("prompt", "response", "code_blocks", "final_answer", "iteration_time")).alias("v"),
    )


def logged_roots(log: DataFrame) -> DataFrame:
    """The readable iteration lines; null, blank, broken and foreign lines give no row."""
    return (
        spread(log.select("run_id", "line"), "line")
        .select("run_id", F.try_parse_json("line").alias("v"))
        .filter(F.try_variant_get("v", "$.type", "string") == "iteration")
        .select("run_id", F.try_variant_get("v", "$.iteration", "bigint").alias("iteration"), F.lit("").alias("record_path"), "v")
        .filter("iteration is not null")
    )


def _level(roots: DataFrame) -> DataFrame:
    """(run_id, iteration, kind m/b/c, parent_path, ordinal, record_path, v) of one level, in one pass."""
    df = roots.withColumn("_prompt", _get(F.col("v"), "prompt")).withColumn("_blocks", _get(F.col("v"), "code_blocks"))
    df = unwrapped(df.drop("v"), "_prompt", "_pw")
    df = df.withColumn("_inner", F.coalesce(_get(F.col("_pw"), "messages"), F.col("_pw"))).drop("_prompt", "_pw")
    df = records(records(df, "_inner", "_m"), "_blocks", "_b").drop("_inner", "_blocks")
    dot = F.when(F.col("record_path") == "", "").otherwise(F.concat("record_path", F.lit(".")))
    df = df.select(*ID, F.col("record_path").alias("parent_path"), dot.alias("_p"), F.inline(F.concat(_slots("m", "_m"), _slots("b", "_b"))))
    df = unwrapped(df, "slot", "v").drop("slot")
    df = df.withColumn("record_path", _path(F.col("_p"), F.col("kind"), F.col("ordinal"))).drop("_p")
    df = df.withColumn("_result", F.when(F.col("kind") == "b", _get(F.col("v"), "result")))
    df = unwrapped(df, "_result", "_r").drop("_result")
    df = df.withColumn("_rc", _get(F.col("_r"), "rlm_calls")).withColumn("_lc", _get(F.col("_r"), "llm_calls")).drop("_r")
    df = records(records(df, "_rc", "_r1"), "_lc", "_r2").withColumn("_c", F.concat("_r1", "_r2")).drop("_rc", "_lc", "_r1", "_r2")
    own = F.array(F.struct("kind", "ordinal", F.col("v").alias("slot")))
    df = df.select(*ID, F.col("parent_path").alias("_pp"), F.col("record_path").alias("_rp"), F.inline(F.concat(own, _slots("c", "_c"))))
    df = unwrapped(df, "slot", "v").drop("slot")
    call = F.col("kind") == "c"
    return df.select(
        *ID,
        "kind",
        F.when(call, F.col("_rp")).otherwise(F.col("_pp")).alias("parent_path"),
        "ordinal",
        F.when(call, _path(F.concat("_rp", F.lit(".")), F.col("kind"), F.col("ordinal"))).otherwise(F.col("_rp")).alias("record_path"),
        "v",
    )


def _below(level: DataFrame) -> DataFrame:
    """The iterations of the trajectories in the metadata of a level's sub-calls."""
    df = level.filter("kind = 'c'").withColumn("_meta", _get(F.col("v"), "metadata")).drop("v", "kind", "ordinal", "parent_path")
    df = unwrapped(df, "_meta", "_mw").withColumn("_it", _get(F.col("_mw"), "iterations")).filter("_it is not null")
    df = records(df, "_it", "_i")
    df = df.select(*ID, F.col("record_path").alias("parent_path"), F.inline(_slots("i", "_i")))
    return unwrapped(df, "slot", "v").select(
        *ID, "parent_path", "ordinal", _path(F.concat("parent_path", F.lit("/")), F.col("kind"), F.col("ordinal")).alias("record_path"), "v"
    )


def flat_tables(iterations: DataFrame | None, log: DataFrame | None) -> dict[str, DataFrame]:
    """{'iterations', 'messages', 'blocks', 'calls', 'all' (the last three together)}: each (run_id, iteration, parent_path, ordinal,
    record_path, v), a row's parent being the row with its parent_path in the table above.

    Defined cases: a null or empty array has no children; null slots count but are not listed;
    an unreadable line is no record; repeated rows come out once; an empty input gives empty
    tables. The depth is that of the data: one pass per level of trajectories in sub-calls."""
    roots = [f(x) for f, x in ((typed_roots, iterations), (logged_roots, log)) if x is not None]
    level = reduce(DataFrame.unionByName, roots)
    top = level.select(*ID, F.lit(None).cast("string").alias("parent_path"), F.col("iteration").alias("ordinal"), "record_path", "v")
    out: dict[str, list[DataFrame]] = {"iterations": [top], "messages": [], "blocks": [], "calls": []}
    levels: list[DataFrame] = []
    while True:
        found = _level(level)
        for kind, letter in (("messages", "m"), ("blocks", "b"), ("calls", "c")):
            out[kind].append(found.filter(F.col("kind") == letter).drop("kind"))
        levels.append(found)
        below = durable(_below(found))
        if below.isEmpty():
            break
        out["iterations"].append(below)
        level = below.select(*ID, "record_path", "v")
    tables = {k: reduce(DataFrame.unionByName, v) for k, v in out.items()}
    return tables | {"all": reduce(DataFrame.unionByName, levels)}


def record_paths(iterations: DataFrame | None, log: DataFrame | None) -> DataFrame:
    """(run_id, iteration, record_path) of every message, block and sub-call, each once.

    Each level is computed once and written with what the next one needs: the paths, and only of
    the calls that have metadata their contents."""
    level = reduce(DataFrame.unionByName, [f(x) for f, x in ((typed_roots, iterations), (logged_roots, log)) if x is not None])
    levels: list[DataFrame] = []
    while True:
        found = _level(level)
        deeper = (F.col("kind") == "c") & _get(F.col("v"), "metadata").isNotNull()
        found = durable(found.select(*ID, "kind", "ordinal", "parent_path", "record_path", F.when(deeper, F.col("v")).alias("v")))
        levels.append(found.select(*ID, "record_path"))
        calls = found.filter("v is not null")
        if calls.isEmpty():
            break
        level = _below(calls).select(*ID, "record_path", "v")
    return reduce(DataFrame.unionByName, levels).distinct()


def merged_schema(rows: DataFrame, text: str) -> T.DataType:
    """The schema that all JSON texts of a column have together, from one aggregation over all of them.

    Fields that some lack are optional; a field of other kinds in other records stays VARIANT; unreadable
    texts count for nothing; without any readable text the schema is an empty struct."""
    found = rows.select(F.schema_of_variant_agg(F.try_parse_json(text))).first()[0]
    if not found or not found.startswith("OBJECT<"):
        return T.StructType()
    return T.DataType.fromDDL(found.replace("OBJECT<", "STRUCT<").replace("VOID", "STRING"))


def related_tables(rows: DataFrame, key: list[str]) -> dict[str, DataFrame]:
    """Flat tables of nested rows, whatever their schema: {'': one row per row, 'a': one per slot of the array a, 'a/b': ...}.

    Each has the key, parent_id, record_id, ordinal and the fields of its record, those of structs as
    a_b; arrays become tables of their own, down to the deepest. record_id is the parent's with the name
    of the array and the ordinal, unique within a key. Null slots count in the ordinal and are left out;
    a null or empty array has no rows; arrays of plain values have the column value; maps stay maps."""
    out: dict[str, DataFrame] = {}

    def walk(df: DataFrame, name: str, kind: T.DataType) -> None:
        flat, arrays = [], []

        def fields(at: Column, struct: T.StructType, prefix: str) -> None:
            for f in struct.fields:
                if isinstance(f.dataType, T.StructType):
                    fields(at[f.name], f.dataType, f"{prefix}{f.name}_")
                elif isinstance(f.dataType, T.ArrayType):
                    arrays.append((f"{prefix}{f.name}", at[f.name], f.dataType.elementType))
                else:
                    flat.append(at[f.name].alias(f"{prefix}{f.name}"))

        if isinstance(kind, T.StructType):
            fields(F.col("_r"), kind, "")
        elif isinstance(kind, T.ArrayType):
            arrays.append(("value", F.col("_r"), kind.elementType))
        else:
            flat.append(F.col("_r").alias("value"))
        ids = [*key, "parent_id", "record_id", "ordinal"]
        out[name] = df.select(*ids, *flat)
        for array, at, element in arrays:
            slots = df.select(*key, F.col("record_id").alias("parent_id"), F.posexplode(at).alias("ordinal", "_r")).filter("_r is not null")
            slots = slots.withColumn("record_id", F.concat("parent_id", F.lit(f"/{array}"), F.col("ordinal").cast("string")))
            walk(slots, f"{name}/{array}" if name else array, element)

    rest = T.StructType([f for f in rows.schema.fields if f.name not in key])
    top = rows.select(*key, F.lit(None).cast("string").alias("parent_id"), F.lit("").alias("record_id"), F.lit(0).alias("ordinal"), F.struct(*[F.col(f"`{f.name}`") for f in rest.fields]).alias("_r"))
    walk(top, "", rest)
    return out


def related_json(rows: DataFrame, key: list[str], text: str) -> dict[str, DataFrame]:
    """related_tables of the JSON texts of a column, under their merged schema. Unreadable texts give no row."""
    schema = merged_schema(rows, text)
    parsed = rows.select(*key, F.try_variant_get(F.try_parse_json(text), "$", schema.simpleString()).alias("_j")).filter("_j is not null")
    return related_tables(parsed.select(*key, "_j.*"), key)
