"""Recurring tool errors from session transcripts, and the advice that fits them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from corpuslens.functions import fixed
from corpuslens.functions.text import first_chars, strip
from corpuslens.operators.ranking import carried

ITEMS_PER_BUCKET = 100_000
# ---- Fixed values: how much of an error text makes its signature and its example -----
SIGNATURE_INPUT_CHARS = 400
SIGNATURE_CHARS = 160
EXAMPLE_CHARS = 200


def error_signature(text: Column, read: int | None = SIGNATURE_INPUT_CHARS, kept: int | None = SIGNATURE_CHARS) -> Column:
    """Start of an error text, or all of it (None), without paths, hex ids and numbers. The order of replacements matters: a
    number of eight or more digits counts as a hex id."""
    out = first_chars(strip(text), read)
    for pattern, placeholder in fixed.ERROR_NOISE:
        out = F.regexp_replace(out, pattern, placeholder)
    return first_chars(out, kept)


def paired_errors(
    items: DataFrame, cwd_prefix: str | None = None, read: int | None = SIGNATURE_INPUT_CHARS, kept: int | None = SIGNATURE_CHARS,
    example: int | None = EXAMPLE_CHARS,
) -> DataFrame:
    """Failed results with the tool and folder of the last earlier call of the same id.

    The signature and the example are cut as ``error_signature`` says (None: whole); ``text_sha256`` is the
    digest of the whole text.

    As-of pairing: a result whose id was never called gets tool ``?``. ``cwd_prefix`` keeps
    results whose call ran below a folder (a plain string prefix).
    """
    item_no = F.col("item_no") if "item_no" in items.columns else F.lit(0)
    rows = items.withColumn("item_no", item_no)
    paired = carried(
        rows, ["session", "tool_id"], F.floor(F.col("pos") / ITEMS_PER_BUCKET), ["pos", "item_no"],
        {"call_tool": F.col("tool"), "call_cwd": F.col("cwd")},
    )
    errors = paired.filter((F.col("kind") == "result") & F.col("is_error"))
    if cwd_prefix:
        errors = errors.filter(F.startswith("call_cwd", F.lit(cwd_prefix)))
    return errors.select(
        "session", "pos", "item_no", "tool_id", F.coalesce("call_tool", F.lit("?")).alias("tool"),
        F.col("call_cwd").alias("cwd"), error_signature(F.col("text"), read, kept).alias("signature"),
        first_chars(F.col("text"), example).alias("example"), F.sha2("text", 256).alias("text_sha256"),
    ).filter(F.col("signature") != "")


def gotchas(errors: DataFrame, *keys: str, min_count: int = 2) -> DataFrame:
    """Errors by tool and signature: count, distinct sessions, first three examples.

    Counts are first taken per session, which shrinks every hot signature before the second
    shuffle; examples come from a rank filter that Spark applies before shuffling.
    """
    group = [*keys, "tool", "signature"]
    per_session = errors.groupBy(*group, "session").agg(F.count("*").alias("_n"))
    counts = (
        per_session.groupBy(*group)
        .agg(F.sum("_n").alias("count"), F.count("*").alias("sessions"))
        .filter(F.col("count") >= min_count)
    )
    order = Window.partitionBy(*group).orderBy("session", "pos", "item_no")
    examples = (
        errors.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= 3)
        .groupBy(*group)
        .agg(F.array_sort(F.collect_list(F.struct("_r", "example"))).alias("_e"))
        .select(*group, F.transform("_e", lambda e: e["example"]).alias("examples"))
    )
    return counts.join(examples, group)


def with_advice(gotcha_rows: DataFrame, rules=fixed.ADVICE_RULES) -> DataFrame:
    """Adds rule_no, title and body of the first rule whose tool (or any) and pattern fit.

    ``rules`` is an ordered pack of (tool or None, pattern, title, body); a user's own pack is
    passed the same way and compiled into one expression, so no rule × row join is needed."""
    none = F.lit(None).cast("struct<rule_no:int,title:string,body:string>")
    picked = F.coalesce(
        *[
            F.when(
                (F.lit(True) if tool is None else F.col("tool") == tool)
                & F.col("signature").rlike(f"(?i){pattern}"),
                F.struct(F.lit(i).alias("rule_no"), F.lit(title).alias("title"), F.lit(body).alias("body")),
            )
            for i, (tool, pattern, title, body) in enumerate(rules)
        ],
        none,
    )
    return gotcha_rows.withColumn("_a", picked).select("*", "_a.*").drop("_a")


def ranked_gotchas(gotcha_rows: DataFrame, limit: int = 10) -> DataFrame:
    """The ``limit`` most frequent ones with their rank (a report: the limit is the feature)."""
    top = gotcha_rows.orderBy(F.desc("count"), "tool", "signature").limit(limit)
    order = Window.orderBy(F.desc("count"), "tool", "signature")
    return top.withColumn("rank", F.row_number().over(order))


def advice_bullets(advised: DataFrame, *keys: str) -> DataFrame:
    """Distinct bullets per key, most frequent gotcha first: (keys, bullets array).

    At most one bullet per rule and key, so the array is bounded by the rule pack.
    """
    rows = advised.filter(F.col("rule_no").isNotNull())
    first = rows.groupBy(*keys, "title", "body").agg(
        F.min(F.struct((-F.col("count")).alias("o"), "tool", "signature")).alias("_o"))
    bullet = F.concat(F.lit("- **"), "title", F.lit("** — "), "body")
    return first.groupBy(*keys).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("_o", bullet.alias("b")))), lambda x: x["b"]
        ).alias("bullets")
    )


# ---- splicing bullets into documents -------------------------------------------------
ANTI_SECTION = r"(?ims)\A(.*?^##[ \t]+anti-patterns[^\n]*\n(?:[ \t]*\n)*)(.*?)(^##\s.*)?\z"
INSERT_BEFORE = ("Dependencies", "Git Conventions", "Security", "CI/CD")
BULLET_TITLE = r"^\s*[-*]\s+\*\*([^*]+)\*\*"


def spliced_documents(documents: DataFrame, section: str = "Anti-Patterns") -> DataFrame:
    """``documents(..., text, bullets)`` with ``patched``, ``added`` and ``skipped``.

    Bullets whose title the section already has, in any letter case, are skipped. Without the
    section a new one is opened in front of the first of four headings, or at the end.
    """
    text, bullets = F.col("text"), F.coalesce("bullets", F.array().cast("array<string>"))
    pattern = ANTI_SECTION.replace("anti-patterns", section.lower())
    found = text.rlike(rf"(?im)^##[ \t]+{section}")
    head, body, rest = (F.regexp_extract(text, pattern, i) for i in (1, 2, 3))
    # a heading on the very last line has no body
    head = F.when(head == "", F.concat(F.regexp_replace(text, r"\s+\z", ""), F.lit("\n"))).otherwise(head)
    titles = F.filter(
        F.transform(F.split(body, "\n"), lambda l: F.lower(strip(F.regexp_extract(l, BULLET_TITLE, 1)))),
        lambda t: t != "",
    )
    title_of = lambda b: F.lower(strip(F.coalesce(F.nullif(F.regexp_extract(b, BULLET_TITLE, 1), F.lit("")), b)))
    fresh = F.filter(F.col("_bullets"), lambda b: ~F.array_contains(F.col("_titles"), title_of(b)))
    rows = (
        documents.withColumn("_bullets", bullets).withColumn("_found", found)
        .withColumn("_titles", F.when(found, titles).otherwise(F.array().cast("array<string>")))
        .withColumn("_fresh", fresh)
    )
    joined = F.array_join("_fresh", "\n")
    trimmed = F.regexp_replace(body, r"\n+\z", "")
    inside = F.concat(
        head, trimmed, F.lit("\n"), joined, F.lit("\n"),
        F.when(F.endswith(body, F.lit("\n\n")), "\n").otherwise(""), rest,
    )
    suffix = F.coalesce(*[
        F.nullif(F.regexp_extract(text, rf"(?ims)^##\s+{c}.*\z", 0), F.lit("")) for c in INSERT_BEFORE
    ], F.lit(""))
    opened = F.concat(
        F.regexp_replace(F.left(text, F.length(text) - F.length(suffix)), r"\s+\z", ""),
        F.lit(f"\n\n## {section}\n\n"), joined, F.lit("\n\n"), F.regexp_replace(suffix, r"\A\n+", ""),
    )
    patched = F.when(F.size("_fresh") == 0, text).when(F.col("_found"), inside).otherwise(opened)
    return rows.select(
        *documents.columns, patched.alias("patched"), F.size("_fresh").alias("added"),
        (F.size("_bullets") - F.size("_fresh")).alias("skipped"),
    )
