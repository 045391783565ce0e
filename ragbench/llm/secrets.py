"""Secret scan with an incremental blob ledger, in DataFrame functions only.

Every version of every path is a blob, addressed by the SHA-256 of its content. The ledger is a table of
(blob, rule version) pairs with the spans found; a scan touches only pairs that the ledger lacks, appends them,
and joins findings back to all paths and versions that hold the blob.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragbench.llm.common import Columns, stored

_WORD = "[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
#: (kind, pattern, group that must have the length or 0, least length). Base kinds first, in the contract's order.
#: access and hex carry their least length inside the pattern: runs are maximal there, so a failing run can hide no match.
#: assign can't: a short value takes characters that a later match could otherwise begin with.
RULES = (
    ("assign", rf"""({_WORD})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]{12,}", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1),
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    ("vcs_token", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 1),
)
BASE_KINDS = 3
#: Raise it whenever a pattern changes; pairs of an older version are scanned anew.
RULE_VERSION = 1
LEDGER_SCHEMA = "blob string, rule_version int, spans array<struct<start:int,kind_no:int,end:int>>"


def _spans(text: Column, kind_no: int, pattern: str, group: int, least: int) -> Column:
    """Spans (code points, end exclusive) of the leftmost non-overlapping matches whose group is long enough.

    Splitting at the pattern gives the pieces between the matches, so a running sum of the lengths of pieces and
    matches is the position of each match.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    size = F.length
    steps = F.arrays_zip(
        F.transform(F.slice(F.split(text, pattern, -1), 1, F.size(found)), size).alias("gap"),
        F.transform(found, size).alias("len"),
        (F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), size) if group else F.transform(found, size)).alias("part"),
    )
    empty = F.array().cast("array<struct<start:int,kind_no:int,end:int>>")
    state = F.aggregate(
        steps, F.struct(F.lit(0).alias("at"), empty.alias("out")),
        lambda acc, s: F.struct(
            (acc["at"] + s["gap"] + s["len"]).alias("at"),
            F.when(
                s["part"] >= least,
                F.concat(acc["out"], F.array(F.struct(
                    (acc["at"] + s["gap"]).alias("start"), F.lit(kind_no).alias("kind_no"), (acc["at"] + s["gap"] + s["len"]).alias("end"),
                ))),
            ).otherwise(acc["out"]).alias("out"),
        ),
    )["out"]
    return F.when(text.rlike(pattern), state).otherwise(empty)


def scan(text: Column) -> Column:
    """All spans of a text, by start, then kind in the order of RULES. Null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    return F.array_sort(F.concat(*(_spans(text, no, pattern, group, least) for no, (_, pattern, group, least) in enumerate(RULES))))


def update_ledger(versions: DataFrame, ledger: DataFrame | None = None, text: str = "text", rule_version: int = RULE_VERSION) -> tuple[DataFrame, DataFrame]:
    """Scan what the ledger lacks. Returns (rows of ``versions`` with ``blob``, the new ledger rows).

    Rows with equal texts share a blob, which is scanned once: the first partial aggregate keeps one text for
    each blob and partition, so a blob that a third of all rows hold is shuffled once for each partition.
    """
    held = versions.withColumn("blob", F.sha2(F.coalesce(F.col(text), F.lit("")), 256))
    todo = held.select("blob", F.col(text).alias("_text")).dropDuplicates(["blob"])
    if ledger is not None:  # after the copies are gone, in the partitions that this left
        seen = ledger.where(F.col("rule_version") == rule_version).select("blob").distinct()
        todo = todo.join(seen.hint("shuffle_merge"), "blob", "left_anti")
    fresh = todo.select("blob", F.lit(rule_version).alias("rule_version"), scan(F.col("_text")).alias("spans"))
    return held, stored(fresh, "ledger")


def find_secrets(versions: DataFrame, ledger: DataFrame | None = None, text: str = "text", rule_version: int = RULE_VERSION) -> tuple[DataFrame, DataFrame]:
    """Findings for every row, and the ledger rows to append for the next run.

    The findings hold all input columns, ``blob`` and ``spans`` (start, kind number, end). Null texts are the
    empty blob; texts are scanned whole, whatever their length; repeated rows stay as many rows; an input column named
    like an output is replaced, all others stay, whatever their names; an empty table gives empty results.
    """
    table = Columns(versions)
    held, fresh = update_ledger(table.rows, ledger, table.name(text), rule_version)
    known = fresh if ledger is None else ledger.where(F.col("rule_version") == rule_version).unionByName(fresh)
    # Most blobs hold nothing; only those with findings take part in the join back.
    hits = stored(known.where(F.size("spans") > 0).select("blob", "spans"), "findings")
    out = held.join(hits, "blob", "left")
    none = F.array().cast("array<struct<start:int,kind_no:int,end:int>>")
    return table.done(out, {"blob": "blob", "spans": F.coalesce("spans", none)}), fresh


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*(F.lit(r[0]) for r in RULES))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind_no"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op9_secret_scan(docs: DataFrame) -> DataFrame:
    """Contract of the query: counts and digests by document; each doc_id is a path with one version."""
    found, _ = find_secrets(docs.select("doc_id", "text"))
    spans = F.col("spans")
    count = lambda no: F.size(F.filter(spans, lambda s: s["kind_no"] == no)).cast("long")
    base = F.filter(spans, lambda s: s["kind_no"] < BASE_KINDS)
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(joined(base), 256).alias("base_sha256"), joined(spans).alias("spans"),
    )


def oracle() -> str:
    """DuckDB SQL for the query, from the same rules: split and extract, then a running sum."""
    parts = []
    for no, (_, pattern, group, least) in enumerate(RULES):
        p = pattern.replace("'", "''")
        part = f"regexp_extract_all(t, '{p}', {group})" if group else "found"
        parts.append(f"""
  SELECT doc_id, {no} AS kind_no, unnest(list_filter(list_transform(range(1, len(found) + 1), lambda i: {{
      's': coalesce(list_sum(gaps[1:i]), 0) + coalesce(list_sum(lens[1:i - 1]), 0),
      'e': coalesce(list_sum(gaps[1:i]), 0) + coalesce(list_sum(lens[1:i]), 0), 'p': parts[i]}}), lambda x: x.p >= {least})) AS x
  FROM (SELECT doc_id, found, list_transform(found, lambda x: length(x)) AS lens,
      list_transform(string_split_regex(t, '{p}'), lambda x: length(x)) AS gaps, list_transform({part}, lambda x: length(x)) AS parts
    FROM (SELECT doc_id, t, regexp_extract_all(t, '{p}') AS found FROM d WHERE regexp_matches(t, '{p}')))""")
    names = ", ".join(f"'{r[0]}'" for r in RULES)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
s AS ({" UNION ALL ".join(parts)}),
j AS (SELECT doc_id, kind_no, x.s AS s, concat([{names}][kind_no + 1], ':', x.s::BIGINT, ':', x.e::BIGINT) AS one FROM s),
g AS (SELECT doc_id, count(*) FILTER (kind_no = 0) AS n_assign, count(*) FILTER (kind_no = 1) AS n_access, count(*) FILTER (kind_no = 2) AS n_hex,
  string_agg(one, ',' ORDER BY s, kind_no) FILTER (kind_no < {BASE_KINDS}) AS base, string_agg(one, ',' ORDER BY s, kind_no) AS spans
  FROM j GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (doc_id)"""
