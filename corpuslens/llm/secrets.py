"""Secret scan with multipart linking (DataFrame operations only).

Spans come from one pass over the text per kind: ``split`` gives the gaps between the matches and
``regexp_extract_all`` the matches, so that a running sum per document gives offsets in code
points. Base kinds are always reported. Weak candidates (a bare key of a known length, an endpoint)
are reported only where complementary parts stand in the same scope: a bare key beside an access
identifier, an endpoint beside a secret, which is an assignment or such a key. An interval join,
cut into cells of the text, links them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from corpuslens.llm.common import cut_lineage

# The kinds in their order with their patterns. A hex run or an access identifier
# that is long enough is a maximal run, so the least length stands in the pattern.
ASSIGN = (
    r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
WEAK_KEY = r"[A-Za-z0-9+/]{%d,}"  # of the shortest length on; whole runs
ENDPOINT = r"https?://[A-Za-z0-9.-]+"
KINDS = ("assign", "access", "hex", "weak_key", "endpoint")
ASSIGN_LENGTH = 12
KEY_LENGTHS = (40,)  #: lengths of bare keys
SCOPE = 500  #: code points between the parts of one credential at most
CELL = 2048  #: code points of a cell of the interval join


def _found(kind: str, pattern: str, if_any: str | None = None) -> Column:
    """array<struct<kind, at, gap, match>>: the matches and the lengths of the gaps before them."""
    text, regex = F.col("text"), F.lit(pattern)
    hits = F.regexp_extract_all(text, regex, F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    pairs = F.transform(hits, lambda m, i: F.struct(F.lit(kind).alias("kind"), i.alias("at"), F.get(gaps, i).alias("gap"), m.alias("match")))
    searched = text.rlike(if_any or pattern)
    none = F.expr("CAST(array() AS array<struct<kind: string, at: int, gap: int, match: string>>)")
    return F.when(searched, pairs).otherwise(none)


def all_spans(docs: DataFrame, key_lengths: tuple[int, ...] = KEY_LENGTHS) -> DataFrame:
    """row, doc_id, kind, start, end: every candidate; a document without one has a row of nulls."""
    # texts that lack the complement of a weak kind aren't searched for it: a bare key needs an
    # access identifier, an endpoint a secret, hence an assignment or what a bare key needs
    hits = F.concat(
        _found("assign", ASSIGN), _found("access", ACCESS), _found("hex", HEX),
        _found("weak_key", WEAK_KEY % min(key_lengths), ACCESS), _found("endpoint", ENDPOINT, f"{ACCESS}|{ASSIGN}"))
    rows = cut_lineage(
        docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), "text")
        .select("row", "doc_id", F.explode_outer(hits).alias("hit")).select("row", "doc_id", "hit.*"),
        "spans",
    )
    upto = Window.partitionBy("row", "doc_id", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    ends = rows.withColumn("end", F.sum(F.col("gap") + F.length("match")).over(upto))
    value = F.regexp_extract("match", ASSIGN, 2)
    good = (
        F.when(F.col("kind") == "assign", F.length(value) >= ASSIGN_LENGTH)
        .when(F.col("kind") == "weak_key", F.length("match").isin(*key_lengths)).otherwise(True)
    )
    kept = F.when(good, F.col("kind"))
    return ends.select("row", "doc_id", kept.alias("kind"), F.when(good, F.col("end") - F.length("match")).alias("start"), F.when(good, F.col("end")).alias("end"))


def _celled(parts: DataFrame, low: Column, high: Column) -> DataFrame:
    """A row per cell of the text that [low, high] touches."""
    return parts.withColumn("cell", F.explode(F.sequence(F.floor(low / CELL), F.floor(high / CELL))))


def near(parts: DataFrame, anchors: DataFrame, scope: int = SCOPE) -> DataFrame:
    """The rows of ``parts`` (spans, each once) with at most ``scope`` code points between them and an
    anchor of the same document. Cells make it an equi join; a semi join, so that no pairs are made."""
    reach = anchors.select(F.col("row").alias("a_row"), (F.col("start") - scope).alias("low"), (F.col("end") + scope).alias("high"))
    reach = _celled(reach, F.col("low"), F.col("high")).withColumnRenamed("cell", "a_cell")
    on = (F.col("row") == F.col("a_row")) & (F.col("cell") == F.col("a_cell")) & (F.col("start") <= F.col("high")) & (F.col("end") >= F.col("low"))
    return _celled(parts, F.col("start"), F.col("end")).join(reach, on, "left_semi").drop("cell").distinct()


def linked(spans: DataFrame, scope: int = SCOPE) -> DataFrame:
    """The weak candidates whose complements are there: a bare key near an access identifier; an
    endpoint near a secret (an assignment or a linked bare key)."""
    keys = near(spans.where("kind = 'weak_key'"), spans.where("kind = 'access'"), scope)
    found = spans.where("kind = 'assign'").unionByName(keys)
    return keys.unionByName(near(spans.where("kind = 'endpoint'"), found, scope))


def secret_scan(docs: DataFrame, key_lengths: tuple[int, ...] = KEY_LENGTHS, scope: int = SCOPE) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    Offsets are code points, the end is exclusive. A null text is empty; a document without spans has
    zeros, the digest of the empty text and an empty list. Repeated rows and rows that share a
    doc_id are documents of their own. Other columns are ignored; an empty table gives none.
    """
    spans = cut_lineage(all_spans(docs, key_lengths), "candidates")
    base = spans.where("kind IS NULL OR kind IN ('assign', 'access', 'hex')")
    rows = base.unionByName(linked(spans, scope))
    no = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    span = F.when(F.col("kind").isNotNull(), F.struct(F.col("start"), no.alias("no"), F.col("end"), F.col("kind")))
    per = rows.groupBy("row", "doc_id").agg(
        *[F.count(F.when(F.col("kind") == k, 1)).alias(f"n_{k}") for k in KINDS[:3]],
        F.array_sort(F.collect_list(span)).alias("found"))

    def listed(found: Column) -> Column:
        return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    return per.select(
        "doc_id", "n_assign", "n_access", "n_hex",
        F.sha2(listed(F.filter("found", lambda s: s["no"] <= 3)), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"))


def _sql_kind(kind: str, pattern: str, where: str) -> str:
    p = pattern.replace("'", "''")
    return (
        f"SELECT doc_id, '{kind}' AS kind, unnest(range(1, len(m) + 1)) AS i, unnest(m) AS hit, unnest(g[1:len(m)]) AS gap FROM "
        f"(SELECT doc_id, regexp_extract_all(text, '{p}') AS m, regexp_split_to_array(text, '{p}') AS g FROM documents{where})"
    )


_HAS_ACCESS = f" WHERE regexp_matches(text, '{ACCESS}')"
_HAS_SECRET = " WHERE regexp_matches(text, '{}|{}')".format(ACCESS, ASSIGN.replace("'", "''"))
_SQL_KINDS = ", ".join(f"'{k}'" for k in KINDS)
_SQL_NEAR = f"EXISTS (SELECT 1 FROM {{}} a WHERE a.doc_id = c.doc_id AND c.s <= a.e + {SCOPE} AND c.e >= a.s - {SCOPE})"
_SQL_LIST = "coalesce(string_agg(concat(kind, ':', s, ':', e), ',' ORDER BY s, no){}, '')"
ORACLE = f"""WITH raw AS ({_sql_kind('assign', ASSIGN, '')} UNION ALL {_sql_kind('access', ACCESS, '')} UNION ALL {_sql_kind('hex', HEX, '')}
 UNION ALL {_sql_kind('weak_key', WEAK_KEY % min(KEY_LENGTHS), _HAS_ACCESS)} UNION ALL {_sql_kind('endpoint', ENDPOINT, _HAS_SECRET)}),
ends AS (SELECT *, CAST(sum(length(gap) + length(hit)) OVER (PARTITION BY doc_id, kind ORDER BY i) AS BIGINT) AS e FROM raw),
spans AS (SELECT doc_id, kind, list_position([{_SQL_KINDS}], kind) AS no, e - length(hit) AS s, e FROM ends
 WHERE CASE kind WHEN 'assign' THEN length(regexp_extract(hit, '{ASSIGN.replace("'", "''")}', 2)) >= {ASSIGN_LENGTH} WHEN 'weak_key' THEN length(hit) IN ({', '.join(map(str, KEY_LENGTHS))}) ELSE true END),
access AS (SELECT * FROM spans WHERE kind = 'access'),
keys AS (SELECT * FROM spans c WHERE kind = 'weak_key' AND {_SQL_NEAR.format('access')}),
parts AS (SELECT * FROM spans WHERE kind = 'assign' UNION ALL SELECT * FROM keys),
kept AS (SELECT * FROM spans WHERE no <= 3 UNION ALL SELECT * FROM keys
 UNION ALL SELECT * FROM spans c WHERE kind = 'endpoint' AND {_SQL_NEAR.format('parts')})
SELECT d.doc_id, count(CASE WHEN kind = 'assign' THEN 1 END) AS n_assign, count(CASE WHEN kind = 'access' THEN 1 END) AS n_access, count(CASE WHEN kind = 'hex' THEN 1 END) AS n_hex,
 sha256({_SQL_LIST.format(' FILTER (no <= 3)')}) AS base_sha256, {_SQL_LIST.format(' FILTER (no IS NOT NULL)')} AS spans
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id GROUP BY d.doc_id"""
