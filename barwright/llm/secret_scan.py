"""Secret scan with corpus-wide ownership frequency, on DataFrame functions alone.

Each text is searched for candidates by kind (leftmost, non-overlapping within a kind). A candidate's hash is counted
over the corpus by distinct owners (sources) and repositories (source and language): what ``copied_owners`` owners or
more hold is a widely copied example, anything else looks like a live credential of its owner. The base kinds
(assign, access, hex) are always reported; the further kinds are added where they look live. A private key is its whole
block, and its hash that of the body; a header without a body is no key.

Spans are in code points, end exclusive. A null text is empty; a null source is the owner '', a null lang the empty one. Repeated
rows are reported each. Overlapping spans of different kinds are all reported; redaction merges them. Empty tables
give empty results; extra columns pass through redaction untouched, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barwright.llm.common import set_apart, small, staged

_ANY = "".join  # letters in either case, spelled out so that every regex engine reads them alike
_WORDS = ["password", "passwd", "secret", "token", "api_?key"]
ASSIGN = "(" + "|".join(_ANY(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in _WORDS) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{12,}"
HEX = "[0-9a-f]{32,}"
KEY_HEADER = "-----BEGIN [A-Z ]*PRIVATE KEY-----"
_LEAD = r"""(?:[\s"'`>#*,;]|\\+[nrt])*+"""  # what may stand before a line of the key: blanks, quotes, written-out line ends
_LAST = r"""(?:(?:\n|\\+n)[\x20\t]*+[A-Za-z0-9+/]{1,15}+={0,2}+(?=[\x20\t]*+(?:[\r\n"'`\\]|\z)))?"""
#: Header to the END line; where no END comes before the next block, header to the end of the base64 lines. The repeats
#: are possessive, so that each header is read once and a long body needs no deep stack.
KEY_BLOCK = (
    KEY_HEADER
    + r"((?:[^-]++|-(?!----(?:BEGIN|END)\x20))*+(?=-----END [A-Z ]*PRIVATE KEY-----)|"
    + f"(?:{_LEAD}(?:Proc-Type|DEK-Info)"
    + r":[^\n\\]*+)*+"
    + f"(?:{_LEAD}[A-Za-z0-9+/=]{{16,}}+)++{_LAST})"
    + "(?:-----END [A-Z ]*PRIVATE KEY-----)?"
)
WEB_TOKEN = r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"
VENDOR = "(?:gh[opsu]_|github_pat_|glpat-|xox[abpr]-|sk_live_|AIza)[A-Za-z0-9_-]{16,}"
#: kind, pattern, group with the value, least length of the value, base
KINDS = [("assign", ASSIGN, 2, 8, True), ("access", ACCESS, 0, 16, True), ("hex", HEX, 0, 32, True), ("key_block", KEY_BLOCK, 1, 1, False), ("web_token", WEB_TOKEN, 0, 1, False), ("vendor", VENDOR, 0, 1, False)]
ANY_KIND = "|".join(f"(?:{p})" for _, p, *_ in KINDS)
#: What oracle() searches: SQL is as it was and knows a key's header alone, so the two agree where no text holds a key.
SQL_KINDS = [("key_block", KEY_HEADER, 0, 1, False) if k[0] == "key_block" else k for k in KINDS]
_SPAN = "struct<start:int,kind_no:int,kind:string,end:int,hash:string>"


def _spans(text: Column, no: int, kind: str, pattern: str, group: int, least: int) -> Column:
    """Spans of one kind: what lies between matches and the matches themselves give the places."""
    p = F.lit(pattern)
    value = F.regexp_extract_all(text, p, F.lit(group))
    if kind == "key_block":  # a key is the same however its lines are broken, indented or quoted
        value = F.transform(value, lambda v: F.regexp_replace(v, r"\\+[nrt]|[^A-Za-z0-9+/=]", ""))
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, p, F.lit(0)).alias("hit"), value.alias("value"))
    empty = F.expr(f"cast(array() as array<{_SPAN}>)")

    def step(acc: Column, x: Column) -> Column:
        start = acc["pos"] + F.char_length(x["gap"])
        end = start + F.coalesce(F.char_length(x["hit"]), F.lit(0))
        span = F.struct(start.alias("start"), F.lit(no).alias("kind_no"), F.lit(kind).alias("kind"), end.alias("end"), F.sha2(x["value"], 256).alias("hash"))
        return F.struct(end.alias("pos"), F.when(F.char_length(x["value"]) >= least, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    found = F.aggregate(parts, F.struct(F.lit(0).alias("pos"), empty.alias("out")), step, lambda a: a["out"])
    return F.when(text.rlike(pattern), found).otherwise(empty)


def all_spans(text: Column) -> Column:
    return F.array_sort(F.concat(*[_spans(text, no, kind, p, g, least) for no, (kind, p, g, least, _) in enumerate(KINDS)]))


def _owned(cands: DataFrame, copied_owners: int) -> DataFrame:
    """cands (row, owner, repository, span) with live of each span's hash.

    What many owners hold is a short table: it is broadcast where its count allows, so that the rows of a hash that is
    everywhere stay where they are; else Spark joins it by a shuffle and splits hot hashes.
    """
    copied = staged(spread(cands).where(F.col("owners") >= copied_owners).select(F.col("hash").alias("copied_hash")), "copied")
    return cands.drop("owner", "repository").join(small(copied), F.col("span.hash") == F.col("copied_hash"), "left").withColumn("live", F.col("copied_hash").isNull()).drop("copied_hash")


def spread(cands: DataFrame) -> DataFrame:
    """hash, owners, repositories: how many of each hold it."""
    held = cands.select(F.col("span.hash").alias("hash"), "owner", "repository").distinct()
    by_owner = held.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("repositories"))
    return by_owner.groupBy("hash").agg(F.count(F.lit(1)).alias("owners"), F.sum("repositories").alias("repositories"))


def _scanned(docs: DataFrame) -> DataFrame:
    """docs with a row number of this run, owner, repository and spans."""
    text = F.coalesce(F.col("text"), F.lit(""))
    owner = F.coalesce(F.col("source"), F.lit(""))
    return docs.withColumns({"scan_row": F.monotonically_increasing_id(), "scan_owner": owner, "scan_repository": F.concat_ws("/", owner, F.coalesce(F.col("lang"), F.lit(""))), "scan_spans": all_spans(text)})


def _candidates(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("scan_row").alias("row"), F.col("scan_owner").alias("owner"), F.col("scan_repository").alias("repository"), F.explode("scan_spans").alias("span"))


def _written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _is_kind(no: int):
    return lambda s: s["kind_no"] == no


def scanned(docs: DataFrame, copied_owners: int = 3) -> DataFrame:
    """One row a document: doc_id, counts of base kinds, base_sha256, spans, n_live, n_copied."""
    rows = staged(_scanned(docs.select("doc_id", "text", "lang", "source")).drop("text", "lang", "source"), "secrets")
    judged = _owned(_candidates(rows), copied_owners)
    n_base = sum(1 for k in KINDS if k[4])
    told = judged.where((F.col("span.kind_no") < n_base) | F.col("live"))
    each = F.struct("span.start", "span.kind_no", "span.kind", "span.end", "live")
    by_row = told.groupBy("row").agg(F.array_sort(F.collect_list(each)).alias("spans"))
    out = rows.select("doc_id", "scan_row").join(by_row, F.col("scan_row") == F.col("row"), "left")
    spans = F.coalesce("spans", F.expr("cast(array() as array<struct<start:int,kind_no:int,kind:string,end:int,live:boolean>>)"))
    count = lambda test: F.size(F.filter(spans, test)).cast("long")
    return out.select(
        "doc_id",
        *[count(_is_kind(no)).alias(f"n_{kind}") for no, (kind, *_) in enumerate(KINDS[:n_base])],
        F.sha2(_written(F.filter(spans, lambda s: s["kind_no"] < n_base)), 256).alias("base_sha256"),
        _written(spans).alias("spans"),
        count(lambda s: s["live"]).alias("n_live"),
        count(lambda s: ~s["live"]).alias("n_copied"),
    )


def redacted(docs: DataFrame, mask: str = "[SECRET]", copied_owners: int = 3) -> DataFrame:
    """docs with live-looking spans of the text masked; n_chars, where there is one, is counted anew in changed rows."""
    names = docs.columns
    docs, back = set_apart(docs, [c for c in names if c.startswith("scan_")])
    text = F.coalesce(F.col("text"), F.lit(""))
    suspect = text.rlike(ANY_KIND)
    rows = staged(_scanned(docs.where(suspect)), "suspects")
    judged = _owned(_candidates(rows), copied_owners).where("live")
    by_row = judged.groupBy(F.col("row").alias("scan_hit")).agg(F.array_sort(F.collect_list(F.struct("span.start", "span.end"))).alias("scan_cut"))

    def step(acc: Column, s: Column) -> Column:
        apart = s["start"] >= acc["pos"]
        kept = F.concat(acc["out"], F.substring(F.col("text"), acc["pos"] + 1, F.greatest(s["start"] - acc["pos"], F.lit(0))), F.lit(mask))
        return F.struct(F.greatest(acc["pos"], s["end"]).alias("pos"), F.when(apart, kept).otherwise(acc["out"]).alias("out"))

    rest = lambda a: F.concat(a["out"], F.substring(F.col("text"), a["pos"] + 1, F.lit(2**31 - 1)))
    clean = F.aggregate("scan_cut", F.struct(F.lit(0).alias("pos"), F.lit("").alias("out")), step, rest)
    hit = rows.join(by_row, F.col("scan_row") == F.col("scan_hit"), "left").withColumn("scan_clean", F.when(F.col("scan_cut").isNotNull(), clean))
    changed = {"text": F.coalesce("scan_clean", "text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("scan_clean").isNotNull(), F.char_length("scan_clean").cast("long")).otherwise(F.col("n_chars"))
    return docs.where(~suspect).select(*docs.columns).unionByName(hit.withColumns(changed).select(*docs.columns)).withColumnsRenamed(back).select(*names)


def oracle(docs: str = "documents", copied_owners: int = 3) -> str:
    """DuckDB's SQL for scanned()."""
    quote = lambda p: p.replace("'", "''")
    each = " UNION ALL ".join(
        f"SELECT uid, owner, repository, {no} AS kind_no, '{kind}' AS kind, string_split_regex(text, '{quote(p)}') AS gaps, regexp_extract_all(text, '{quote(p)}', 0) AS hits, "
        f"regexp_extract_all(text, '{quote(p)}', {g}) AS vals, {least} AS least FROM d WHERE regexp_matches(text, '{quote(p)}')"
        for no, (kind, p, g, least, _) in enumerate(SQL_KINDS)
    )
    n_base = sum(1 for k in KINDS if k[4])
    counts = ", ".join(f"CAST(count(*) FILTER (kind_no = {no}) AS BIGINT) AS n_{kind}" for no, (kind, *_) in enumerate(KINDS[:n_base]))
    written = "coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, kind_no){}, '')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS uid, doc_id, coalesce(text, '') AS text, coalesce(source, '') AS owner, coalesce(source, '') || '/' || coalesce(lang, '') AS repository FROM {docs}),
m AS ({each}),
i AS (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM m),
s AS (SELECT uid, owner, repository, kind_no, kind, hits[i] AS hit, vals[i] AS value,
  list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) AS start FROM i WHERE length(vals[i]) >= least),
f AS (SELECT value, count(DISTINCT owner) AS owners FROM s GROUP BY value),
j AS (SELECT uid, kind_no, kind, CAST(start AS BIGINT) AS start, CAST(start + length(hit) AS BIGINT) AS stop, owners < {copied_owners} AS live FROM s JOIN f USING (value) WHERE kind_no < {n_base} OR owners < {copied_owners}),
g AS (SELECT uid, {counts}, sha256({written.format(f" FILTER (kind_no < {n_base})")}) AS base_sha256, {written.format("")} AS spans, count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_copied FROM j GROUP BY uid)
SELECT doc_id, {", ".join(f"coalesce(n_{kind}, 0) AS n_{kind}" for kind, *_ in KINDS[:n_base])}, coalesce(base_sha256, sha256('')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied
FROM d LEFT JOIN g USING (uid)
"""
