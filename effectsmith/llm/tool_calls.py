"""Tool-call linking: join calls with results, order them, validate arguments, write canonical JSON.

* calls (conv_id, call_id, name, arguments, after, pos): ``arguments`` is JSON text, ``after`` the id of
  the call whose result this call uses (null: none), ``pos`` the place in the conversation.
* results (conv_id, call_id, content, pos).
* schemas (name, field, type, required): ``type`` is integer, number, string, boolean, array or object.

Calls and results meet by hash join on (conv_id, call_id). The level of a call, one more than that of
the call it waits for, comes from pointer doubling: each round joins every call with the call its
pointer names, so a chain of n calls takes log2(n) rounds however its rows are spread; pointers that
never reach a root lie on a cycle. Every key of these joins is one call, so one conversation with a
third of all rows is spread like any other.

Defined results: calls with a null id are dropped; of repeated ids the row with the least (pos, name,
arguments) stays and ``n_calls`` counts them; of several results the least (pos, content) links and
``n_results`` counts them; results without a call are rows with status ``orphan``; a call that waits
for an unknown id is a root with ``dangling`` true; on a cycle the level is null. Arguments that are
not one JSON object (one that repeats a name is none), lack a required field, have an unknown field or a
wrong type are not valid; ``1.0`` and whole numbers of any size are integers. A tool without schema is not
valid. Of several types of one field any fits, and it is required if one row says so; a null or unknown type
fits nothing; a row with a null field only says that the tool exists. Empty tables give an empty result. Other
columns are ignored. Turns of other roles than user, assistant and system are neither calls nor results.

Canonical JSON has its names in the order of their UTF-16 units and no blanks; whole numbers without fraction or exponent
keep their digits, others have the shortest form of their 64-bit value (``1e3`` is 1000, ``1.50`` is 1.5,
``1e-7`` stays), so equal values have one text. It is made by splitting at quotes: texts of any length pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from effectsmith.functions.lineage import written

KEY = ["conv_id", "call_id"]
TYPES = {"integer": "WHOLE", "number": "WHOLE|BIGINT|DOUBLE|FLOAT|DECIMAL.*", "string": "STRING", "boolean": "BOOLEAN", "array": "ARRAY.*", "object": "OBJECT.*"}


def one_call_each(calls: DataFrame) -> DataFrame:
    whole = calls.filter("conv_id is not null and call_id is not null")
    first = F.min(F.struct("pos", "name", "arguments", "after")).alias("c")
    return whole.groupBy(*KEY).agg(first, F.count("*").alias("n_calls")).select(*KEY, "c.*", "n_calls")


def levels(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, level, dangling) of distinct calls by pointer doubling."""
    known = calls.select("conv_id", F.col("call_id").alias("after"), F.lit(True).alias("is_call"))
    state = calls.select(*KEY, "after").join(known, ["conv_id", "after"], "left")
    state = written(
        state.select(
            *KEY,
            F.when(F.col("is_call"), F.col("after")).alias("target"),
            F.when(F.col("is_call"), 1).otherwise(0).cast("long").alias("steps"),
            (F.col("after").isNotNull() & F.col("is_call").isNull()).alias("dangling"),
        ),
        "call-levels",
    )
    reach, total = 1, state.count()
    while reach <= total and not state.filter("target is not null").isEmpty():
        further = state.select("conv_id", F.col("call_id").alias("target"), F.col("target").alias("next"), F.col("steps").alias("more"))
        open_calls = state.filter("target is not null").join(further, ["conv_id", "target"])
        moved = open_calls.select(*KEY, F.col("next").alias("target"), (F.col("steps") + F.col("more")).alias("steps"), "dangling")
        state = written(state.filter("target is null").unionByName(moved), "call-levels")
        reach *= 2
    return state.select(*KEY, F.when(F.col("target").isNull(), F.col("steps")).alias("level"), "dangling")


def number_text(t: Column) -> Column:
    """The canonical text of a JSON number."""
    d = t.cast("double")
    size = F.abs(d)
    fixed = lambda places: F.regexp_replace(d.cast(f"decimal(38,{places})").cast("string"), r"\.?0+$", "")
    short = F.regexp_replace(d.cast("string"), r"\.0(?![0-9])", "")
    return (
        F.when((size == 0) | t.rlike("^-?[0-9]+$"), F.when(size == 0, "0").otherwise(t))
        .when((size >= 1e-3) & (size < 1e7), short)
        .when((size >= 1e7) & (size < 1e21), fixed(12))
        .when((size >= 1e-6) & (size < 1e-3), fixed(24))
        .when(size < 1e-6, F.replace(short, F.lit("E"), F.lit("e")))
        .when(size < float("inf"), F.replace(short, F.lit("E"), F.lit("e+")))
        .otherwise(t)
    )


def canonical_numbers(json: Column) -> Column:
    """``json`` (as ``to_json`` writes it) with canonical numbers; its strings stay.

    Escaped backslashes and quotes become control characters, which no JSON text holds, so that every other
    part between quotes is outside of strings.
    """
    back, quote = F.lit("\u0001"), F.lit("\u0002")
    bare = F.replace(F.replace(json, F.lit("\\\\"), back), F.lit('\\"'), quote)
    outside = lambda p: F.array_join(
        F.transform(F.regexp_extract_all(p, F.lit("-?[0-9][0-9.eE+-]*|[^0-9-]+"), F.lit(0)), lambda t: F.when(t.rlike("^-?[0-9]"), number_text(t)).otherwise(t)), ""
    )
    parts = F.transform(F.split(bare, '"'), lambda p, i: F.when((i % 2 == 0) & p.rlike("[0-9]"), outside(p)).otherwise(p))
    whole = F.array_join(parts, '"')
    return F.replace(F.replace(whole, quote, F.lit('\\"')), back, F.lit("\\\\"))


def validated(calls: DataFrame, schemas: DataFrame) -> DataFrame:
    """Adds ``canonical`` (sorted keys, no blanks) and ``errors`` (sorted; empty: valid)."""
    wanted = F.create_map(*[F.lit(x) for pair in TYPES.items() for x in pair])
    by_field = schemas.groupBy("name", "field").agg(
        F.array_join(F.array_sort(F.collect_set(F.element_at(wanted, F.col("type")))), "|").alias("pattern"), F.max(F.coalesce("required", F.lit(False))).alias("required")
    )
    there = F.col("field").isNotNull()
    by_tool = by_field.groupBy("name").agg(
        F.map_from_entries(F.collect_list(F.when(there, F.struct("field", "pattern")))).alias("types"),
        F.array_sort(F.collect_set(F.when(there & F.col("required"), F.col("field")))).alias("needed"),
    )
    read = calls.withColumn("tree", F.try_parse_json("arguments")).withColumn("fields", F.json_object_keys("arguments"))
    kinds = F.when(
        F.schema_of_variant("tree").startswith("OBJECT"),
        F.expr("transform(map_entries(cast(tree as map<string,variant>)), e -> struct(e.key as key, schema_of_variant(e.value) as kind, to_json(e.value) as text))"),
    )
    kinds = F.transform(
        kinds,
        lambda e: F.struct(
            e["key"].alias("key"),
            F.when(e["kind"].rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$") & number_text(e["text"]).rlike("^-?[0-9]+$"), "WHOLE").otherwise(e["kind"]).alias("kind"),
        ),
    )
    joined = read.withColumn("kinds", kinds).join(by_tool, "name", "left")
    errors = (
        F.when(F.col("types").isNull(), F.array(F.lit("no schema")))
        .when(F.col("kinds").isNull(), F.array(F.lit("not an object")))
        .otherwise(
            F.array_sort(
                F.concat(
                    F.transform(F.array_except("needed", "fields"), lambda x: F.concat(F.lit("missing "), x)),
                    F.transform(F.array_except("fields", F.map_keys("types")), lambda x: F.concat(F.lit("unknown "), x)),
                    F.transform(
                        F.filter(
                            "kinds",
                            lambda e: F.element_at("types", e["key"]).isNotNull()
                            & ~F.coalesce(F.regexp_like(e["kind"], F.concat(F.lit("^("), F.element_at("types", e["key"]), F.lit(")$"))), F.lit(False)),
                        ),
                        lambda e: F.concat(F.lit("type "), e["key"]),
                    ),
                )
            )
        )
    )
    return joined.withColumn("errors", errors).withColumn("canonical", canonical_numbers(F.to_json("tree"))).drop("tree", "fields", "kinds", "types", "needed")


def linked(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row per call, and one per result id without call, with level, status and canonical JSON."""
    own = one_call_each(calls.select(*KEY, "pos", "name", "arguments", "after"))
    ranked = levels(own.select(*KEY, "after"))
    answers = (
        results.filter("conv_id is not null and call_id is not null")
        .groupBy(*KEY)
        .agg(F.min(F.struct(F.col("pos").alias("result_pos"), "content")).alias("r"), F.count("*").alias("n_results"))
        .select(*KEY, "r.*", "n_results")
    )
    judged = validated(own, schemas).join(ranked, KEY)
    called = judged.join(answers.hint("shuffle_hash"), KEY, "left").withColumn(
        "status", F.when(F.col("n_results").isNull(), "unanswered").otherwise("linked")
    )
    orphans = answers.join(own.select(*KEY), KEY, "left_anti").withColumn("status", F.lit("orphan"))
    every = called.unionByName(orphans, allowMissingColumns=True)
    # to_json sorts nothing: the names stand in sorted order here; ``arguments`` keeps its own text
    # where it is not JSON, so that nothing is lost.
    quoted = lambda c: F.coalesce(F.substring(F.to_json(F.array(c)), F.lit(2), F.length(F.to_json(F.array(c))) - 2), F.lit("null"))
    body = F.concat(
        F.lit('{"after":'), quoted(F.col("after").cast("string")),
        F.lit(',"arguments":'), F.coalesce("canonical", quoted(F.col("arguments"))),
        F.lit(',"call_id":'), quoted(F.col("call_id").cast("string")),
        F.lit(',"content":'), quoted(F.col("content")),
        F.lit(',"name":'), quoted(F.col("name")),
        F.lit("}"),
    )
    return every.select(
        *KEY, "name", "pos", "level", "status", "dangling", "n_calls", "n_results",
        (F.size("errors") == 0).alias("valid"), F.array_join("errors", "; ").alias("errors"), body.alias("json"),
    )


def from_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of plain chat turns: a user turn calls ``reply``, the next turn answers it.

    The call's id is its turn number; it waits for the user turn two places before. System turns call
    ``configure``. Text of assistant turns is the result of the turn before.
    """
    words = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    calls = turns.filter("role in ('user', 'system')").select(
        "conv_id",
        F.col("turn").alias("call_id"),
        F.when(F.col("role") == "user", "reply").otherwise("configure").alias("name"),
        F.to_json(F.struct(words.alias("words"), F.col("turn"), F.col("text"))).alias("arguments"),
        F.when(F.col("turn") >= 2, F.col("turn") - 2).alias("after"),
        F.col("turn").alias("pos"),
    )
    results = turns.filter("role = 'assistant'").select(
        "conv_id", (F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"), F.col("turn").alias("pos")
    )
    return calls, results


SCHEMA_ROWS = [
    ("reply", "words", "integer", True), ("reply", "turn", "integer", True), ("reply", "text", "string", True),
    ("configure", "words", "integer", True), ("configure", "turn", "integer", False), ("configure", "text", "string", True),
]


def chat_schemas(spark) -> DataFrame:
    rows = ", ".join(f"('{n}', '{f}', '{t}', {str(r).lower()})" for n, f, t, r in SCHEMA_ROWS)
    return spark.sql(f"select * from values {rows} as t(name, field, type, required)")
