"""The write contract of guarded projects."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


@dataclass(frozen=True)
class Contract:
    """``max_chars`` 0 is no limit; ``max_delete`` 0 allows no deletion."""

    # The default contract's limits, keys and allowed values.
    projects: tuple[str, ...]
    max_chars: int = 3000
    required: tuple[str, ...] = ("chunk", "bucket", "kind", "title", "ts", "agent", "source")
    enums: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"kind": ("log", "ref"), "source": ("session", "multibrain")})
    max_delete: int = 25

    def guards(self, project: str | Column = "project_id") -> Column:
        return (F.col(project) if isinstance(project, str) else project).isin(*self.projects)


def _value(key: str) -> Column:
    return F.trim(F.coalesce(F.col("meta")[key], F.lit("")))


def violations(docs: DataFrame, contract: Contract) -> DataFrame:
    """Every broken rule of every document: ``project_id, id, rule, detail``."""

    def broken(when: Column, rule: str, detail: Column) -> Column:
        return F.when(when, F.struct(F.lit(rule).alias("rule"), detail.alias("detail")))

    size = F.char_length("content")
    rules = [broken(size > contract.max_chars, "max_chars", size.cast("string"))] if contract.max_chars > 0 else []
    rules += [broken(_value(k) == "", "required_meta", F.lit(k)) for k in contract.required]
    rules += [broken((_value(k) != "") & ~_value(k).isin(*allowed), "enum_meta", F.concat(F.lit(f"{k}="), _value(k))) for k, allowed in contract.enums.items()]
    rows = docs.where(contract.guards())
    return rows.select("project_id", "id", F.explode(F.array_compact(F.array(*rules))).alias("v")).select("project_id", "id", "v.rule", "v.detail")


def guard_split(docs: DataFrame, contract: Contract, batch: str | None = None) -> DataFrame:
    """``docs`` with ``accepted``: of a batch with any violation nothing is, without a batch
    column each document stands for itself."""
    bad = violations(docs, contract)
    on = ["project_id", "id"]
    if batch:
        bad = bad.join(docs.select("project_id", "id", batch).distinct(), on).select("project_id", batch)
        on = ["project_id", batch]
    marks = bad.select(*on).distinct().withColumn("__bad", F.lit(True))
    return docs.join(marks, on, "left").withColumn("accepted", F.col("__bad").isNull()).drop("__bad")


def scan_refusals(requests: DataFrame, contract: Contract) -> DataFrame:
    """Scans into guarded projects are refused: a file cannot have the meta that is asked for."""
    return requests.withColumn("allowed", ~contract.guards())


def delete_refusals(requests: DataFrame, contract: Contract) -> DataFrame:
    """Requests ``request_id, project_id`` (a row for each point): how many points, and whether allowed."""
    n = requests.groupBy("request_id", "project_id").agg(F.count("*").alias("points"))
    return n.withColumn("allowed", ~contract.guards() | (F.col("points") <= contract.max_delete))


def project_delete_refusals(requests: DataFrame, contract: Contract) -> DataFrame:
    return requests.withColumn("allowed", ~contract.guards())


def violation_counts(found: DataFrame) -> DataFrame:
    """Violations of each rule, and how many documents have them."""
    return found.groupBy("rule").agg(F.count("*").alias("violations"), F.count_distinct("project_id", "id").alias("documents"))


def guard_report(docs: DataFrame, found: DataFrame, show: int = 10) -> DataFrame:
    """For each project: documents, bad ones, the first ``show`` violations and how many more there are."""
    n = F.row_number().over(Window.partitionBy("project_id").orderBy("id", "rule", "detail"))
    first = found.withColumn("n", n).where(F.col("n") <= show).groupBy("project_id").agg(F.array_sort(F.collect_list(F.struct("n", F.concat_ws(" ", "id", "rule", "detail").alias("line")))).alias("l"))
    bad = found.groupBy("project_id").agg(F.count_distinct("id").alias("bad_documents"), F.greatest(F.count("*") - show, F.lit(0)).alias("more"))
    every = docs.groupBy("project_id").agg(F.count("*").alias("documents"))
    return bad.join(every, "project_id").join(first, "project_id").select("project_id", "documents", "bad_documents", "more", F.transform("l", lambda x: x["line"]).alias("shown"))
