"""The audit of whole profiles, and again of what has changed (N-1).

A family of findings is what it reads and how it judges. Beside its findings each run
keeps a fingerprint per document and family, a sum over the rows that the family has
read. The next run reads the fingerprints first, judges the documents whose rows or
rules have changed, and takes the findings of all others from the run before.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators import compare, structure
from quire.operators.job import read_run, run_exists, write_run
from quire.sources.lineage import stored

FEW = 1 << 20  # documents to be judged whose ids are broadcast


class Family:
    """reads: tables with doc_id; judge: these tables to (doc_id, name, ok); rules: what else its findings depend on."""

    def __init__(self, reads: list[DataFrame], judge: Callable[..., DataFrame], rules: object = None):
        self.reads, self.judge, self.rules = reads, judge, rules

    def findings(self, docs: DataFrame | None = None, n: int | None = None) -> DataFrame:
        """(doc_id, name, ok), of all documents or of those in a table, n if known: the ids of few go to the rows, of more the rows to them, dealt by their number."""
        if docs is None:
            reads = self.reads
        elif n is not None and n <= FEW:
            reads = [t.join(F.broadcast(docs.select("doc_id")), "doc_id", "left_semi") for t in self.reads]
        else:
            reads = [structure.dealt(t, t.count()).join(docs.select("doc_id"), "doc_id", "left_semi") for t in self.reads]
        return self.judge(*reads).select("doc_id", "name", "ok")

    def prints(self, docs: DataFrame) -> DataFrame:
        """(doc_id, print): the same for the same rows in any order, and the same rules."""
        parts = []
        for k, t in enumerate(self.reads):
            h = F.xxhash64(F.lit(k), *[F.col(c) for c in sorted(t.columns) if c != "doc_id"])
            # Hashes of null columns don't differ by place, so which are null is hashed too.
            nulls = F.concat(*[F.when(F.col(c).isNull(), "1").otherwise("0") for c in sorted(t.columns)])
            parts.append(t.select("doc_id", F.xxhash64(h, nulls).alias("h")))
        every = docs.select("doc_id", F.lit(None).cast("long").alias("h"), F.lit(True).alias("here"))
        for more in parts:
            every = every.unionAll(more.withColumn("here", F.lit(False)))
        # One group for documents and their rows, so that no join sorts them.
        sums = every.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("h").alias("n"), F.sum(F.col("h").cast("decimal(20,0)")).alias("s"), F.bit_xor("h").alias("x"), F.bool_or("here").alias("here")).where("here")
        told = F.concat_ws("|", F.lit(json.dumps(self.rules, sort_keys=True, default=str)), F.col("n").cast("string"), F.col("s").cast("string"), F.col("x").cast("string"))
        return sums.select("doc_id", F.md5(told.cast("binary")).alias("print"))


def families(tables: dict[str, DataFrame], profile: dict) -> dict[str, Family]:
    """The families of a profile that its tables allow. tables: documents, sections (inches), blocks, styles; profile: page, pageNumbers, styles, structure."""
    t, out = tables, {}
    if "page" in profile:
        out["page"] = Family([t["sections"]], lambda s: compare.diff_page(s, profile["page"]), profile["page"])
    if "pageNumbers" in profile:
        out["pageNumbers"] = Family([t["documents"].select("doc_id"), t["sections"]], lambda d, s: compare.diff_page_numbers(d, s, profile["pageNumbers"]), profile["pageNumbers"])
    if "styles" in profile:
        out["styles"] = Family([t["documents"].select("doc_id"), t["styles"], t["blocks"]], lambda d, s, b: compare.diff_styles(d, s, structure.style_usage(b), profile["styles"]), profile["styles"])
    if "structure" in profile:
        out["structure"] = Family([t["blocks"]], lambda b: compare.diff_structure(structure.summarize(structure.classify(b, t["blocks"].count())), profile["structure"]), profile["structure"])
    return out


def audit(of: dict[str, Family]) -> DataFrame:
    """(doc_id, family, name, ok): all findings of all families."""
    out = None
    for name, family in of.items():
        rows = family.findings().select("doc_id", F.lit(name).alias("family"), "name", "ok")
        out = rows if out is None else out.unionByName(rows)
    return out


def audit_again(docs: DataFrame, of: dict[str, Family], path: str) -> dict[str, DataFrame]:
    """Judges what the run under the path, if there is one, doesn't know yet; writes the new run there and returns it.

    prints: doc_id, family, print, judged (whether this run did); findings: doc_id,
    family, name, ok. Documents that have gone leave no findings.
    """
    spark = docs.sparkSession
    old = read_run(spark, path) if run_exists(spark, path) else None
    prints, findings = None, None
    for name, family in of.items():
        if old is None:
            now, found = family.prints(docs).withColumn("judged", F.lit(True)), family.findings()
        else:
            before = old["prints"].where(F.col("family") == name).select("doc_id", F.col("print").alias("_before"))
            now = stored(family.prints(docs).join(before, "doc_id", "left").select("doc_id", "print", (~F.col("print").eqNullSafe(F.col("_before"))).alias("judged")))
            found = old["findings"].where(F.col("family") == name).select("doc_id", "name", "ok").join(now.where("NOT judged"), "doc_id", "left_semi")
            if changed := now.where("judged").count():
                found = found.unionByName(family.findings(now.where("judged"), changed))
        now, found = now.withColumn("family", F.lit(name)), found.withColumn("family", F.lit(name))
        prints = now if prints is None else prints.unionByName(now)
        findings = found if findings is None else findings.unionByName(found)
    write_run({"prints": prints, "findings": findings}, path, force=True)
    return read_run(spark, path)
