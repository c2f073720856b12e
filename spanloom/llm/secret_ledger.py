"""Secret scan over an incremental blob ledger: every version of a text is addressed by the hash
of its content, only (blob, rule version) pairs that the ledger lacks are scanned, and findings are
joined back to all rows that hold the blob.

DataFrame operations only. A blob is scanned once however many rows hold it; the scanned text is
shuffled once by document id, never by blob, so copies do not meet in one task. Findings are rows,
not arrays, until the last step, so a text with very many secrets costs no more than its matches.

Defined cases: a null text is the empty blob, without findings. Repeated rows get a row each.
A null doc_id is kept. Columns besides id and text are not read. An empty ledger or table works.
"""

from __future__ import annotations

from dataclasses import dataclass
from hashlib import sha256

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm.common import columns, stored, text_or_empty
from spanloom.session import compute_once


@dataclass(frozen=True)
class SecretRule:
    """``hint`` is a plain string (any of several) that each match holds, or none. A match stays
    if its ``group`` has ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    hints: tuple[str, ...] = ()

    @property
    def version(self) -> str:
        stated = "\n".join([self.kind, self.pattern, str(self.group), str(self.least)])
        return sha256(stated.encode()).hexdigest()[:16]


# The base kinds in their listed order.
BASE_RULES = (
    SecretRule(
        "assign",
        r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        group=2,
        least=6,
    ),
    SecretRule("access", r"AKIA[A-Z0-9]+", least=20, hints=("AKIA",)),
    SecretRule("hex", r"[0-9a-f]{24,}", least=24),
)
# Kinds the method adds.
MORE_RULES = (
    SecretRule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}", hints=("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    SecretRule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}", hints=("xox",)),
    SecretRule(
        "jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", hints=("eyJ",)
    ),
    SecretRule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", hints=("PRIVATE KEY-----",)),
)
RULES = BASE_RULES + MORE_RULES


def content_address(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def _present(rule: SecretRule) -> Column:
    if not rule.hints:
        return F.col("text").rlike(rule.pattern)
    hinted = F.lit(False)
    for hint in rule.hints:
        hinted = hinted | F.col("text").contains(hint)
    return hinted


def _pieces(rule: SecretRule) -> Column:
    """Per match: length of the gap before it, of the match, and of the group that is judged.

    The gaps and the matches come from the same scan rule (leftmost, not overlapping), so the
    running sum of both gives the places.
    """
    whole = F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(0))
    judged = F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(rule.group))
    gaps = F.split("text", rule.pattern, -1)
    sizes = F.zip_with(
        F.zip_with(whole, judged, lambda m, g: F.struct(F.length(m).alias("size"), F.length(g).alias("judged"))),
        F.slice(gaps, 1, F.greatest(F.size(gaps) - 1, F.lit(0))),
        lambda m, gap: F.struct(F.length(gap).alias("gap"), m["size"].alias("size"), m["judged"].alias("judged")),
    )
    wanted = F.array_contains("todo", rule.version) & _present(rule)
    return F.when(wanted, sizes)


def find_spans(blobs: DataFrame, rules: tuple[SecretRule, ...] = RULES) -> DataFrame:
    """blobs(blob, text, todo: versions to scan) -> blob, version, kind, start, end.

    Code points, end exclusive."""
    found = F.filter(
        F.array(
            *[
                F.struct(
                    F.lit(r.version).alias("version"), F.lit(r.kind).alias("kind"),
                    F.lit(r.least).alias("least"), _pieces(r).alias("pieces"),
                )
                for r in rules
            ]
        ),
        lambda x: F.size(x["pieces"]) > 0,
    )
    rows = compute_once(blobs, "found", found).select("blob", F.explode("found").alias("f"))
    rows = rows.select("blob", "f.version", "f.kind", "f.least", F.posexplode("f.pieces").alias("at", "p"))
    upto = Window.partitionBy("blob", "version").orderBy("at").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    rows = rows.dropDuplicates(["blob", "version", "at"]).withColumn(
        "end", F.sum(F.col("p.gap") + F.col("p.size")).over(upto)
    )
    return rows.where(F.col("p.judged") >= F.col("least")).select(
        "blob", "version", "kind", (F.col("end") - F.col("p.size")).alias("start"), "end"
    )


def scan(
    docs: DataFrame,
    rules: tuple[SecretRule, ...] = RULES,
    ledger: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Scan what the ledger lacks.

    Returns (held, ledger): ``held`` has doc_id and blob of every row of ``docs``; ``ledger`` has
    one row per blob and rule version ever scanned: blob, version, kind, spans (array of
    start/end). It is written to the shared folder; pass it in again with the next batch.
    """
    docs = columns(docs, "doc_id", "text")
    held = docs.select("doc_id", content_address(F.col("text")).alias("blob"))
    versions = F.array(*[F.lit(r.version) for r in rules])
    new = held.groupBy("blob").agg(F.min("doc_id").alias("doc_id")).withColumn("todo", versions)
    if ledger is not None:
        done = ledger.groupBy("blob").agg(F.collect_set("version").alias("done"))
        new = new.join(done, "blob", "left").select(
            "blob", "doc_id",
            F.array_except("todo", F.coalesce("done", F.array().cast("array<string>"))).alias("todo"),
        ).where(F.size("todo") > 0)
    new = stored(new, "blobs")
    blobs = docs.alias("d").join(
        new.alias("n"),
        F.col("d.doc_id").eqNullSafe(F.col("n.doc_id"))
        & (content_address(F.col("d.text")) == F.col("n.blob")),
    ).select("n.blob", text_or_empty("d.text").alias("text"), "n.todo")
    spans = find_spans(blobs, rules).groupBy("blob", "version").agg(
        F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans")
    )
    kinds = F.create_map(*[F.lit(x) for r in rules for x in (r.version, r.kind)])
    scanned = new.select("blob", F.explode("todo").alias("version"))
    nothing = F.array().cast("array<struct<start:bigint,end:bigint>>")
    fresh = scanned.join(spans, ["blob", "version"], "left").select(
        "blob", "version", kinds[F.col("version")].alias("kind"),
        F.coalesce("spans", nothing).alias("spans"),
    )
    fresh = stored(fresh, "ledger")
    return held, fresh if ledger is None else ledger.unionByName(fresh)


def spans_by_blob(ledger: DataFrame, rules: tuple[SecretRule, ...] = RULES) -> DataFrame:
    """blob, spans: (start, place of the kind in the rules, kind, end), in that order."""
    place = F.create_map(*[F.lit(x) for i, r in enumerate(rules) for x in (r.version, i)])
    rows = ledger.where(F.col("version").isin([r.version for r in rules])).select(
        "blob", "kind", place[F.col("version")].alias("place"), F.explode("spans").alias("s")
    )
    return rows.groupBy("blob").agg(
        F.sort_array(F.collect_list(F.struct("s.start", "place", "kind", "s.end"))).alias("spans")
    )


def findings(held: DataFrame, ledger: DataFrame, rules: tuple[SecretRule, ...] = RULES) -> DataFrame:
    """doc_id, blob, spans (an empty array without findings) for every row of ``held``."""
    nothing = F.array().cast("array<struct<start:bigint,place:int,kind:string,end:bigint>>")
    return held.join(spans_by_blob(ledger, rules), "blob", "left").select(
        "doc_id", "blob", F.coalesce("spans", nothing).alias("spans")
    )


def redact(docs: DataFrame, rules: tuple[SecretRule, ...] = RULES, mark: str = "[secret]") -> DataFrame:
    """``docs`` with every found span replaced by ``mark``; overlapping spans are replaced once.

    Only rows whose blob has findings are changed; n_chars, if there, follows the text.
    """
    held, ledger = scan(docs, rules)
    spans = spans_by_blob(ledger, rules).withColumnRenamed("spans", "_spans")
    rows = docs.withColumn("_blob", content_address(F.col("text")))
    rows = rows.join(spans.withColumnRenamed("blob", "_blob"), "_blob", "left")
    # Fold the sorted spans into the kept pieces: (end so far, text so far).
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))

    def step(state: Column, span: Column) -> Column:
        gap = F.substring("text", (state["at"] + 1).cast("int"), (span["start"] - state["at"]).cast("int"))
        fresh = span["start"] >= state["at"]
        return F.struct(
            F.greatest(state["at"], span["end"]).alias("at"),
            F.when(fresh, F.concat(state["out"], gap, F.lit(mark))).otherwise(state["out"]).alias("out"),
        )

    folded = F.aggregate(
        "_spans", start, step,
        lambda s: F.concat(s["out"], F.substring("text", (s["at"] + 1).cast("int"), F.lit(2**31 - 1))),
    )
    rows = rows.withColumn("text", F.when(F.size("_spans") > 0, folded).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        changed = F.when(F.size("_spans") > 0, F.length("text").cast(docs.schema["n_chars"].dataType))
        rows = rows.withColumn("n_chars", F.coalesce(changed, F.col("n_chars")))
    return rows.select(*docs.columns)
