"""Documents in, tables and reports out: text and Markdown files, CSV, JSON, and results kept per origin."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TEXT_ENDINGS = (".txt", ".md")


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One small file in any store that Spark reaches: first beside it, then renamed, so readers never see half of it."""
    target, fs = _path(spark, path)
    part, _ = _path(spark, f"{path}.part")
    out = fs.create(part, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()
    fs.delete(target, False)
    if not fs.rename(part, target):
        raise OSError(f"{path} could not be put in place")


def read_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()["value"]


def load_documents(spark: SparkSession, path: str) -> DataFrame:
    """(source, text) of .txt and .md files; other endings are refused."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("source"), "content")
    known = F.lit(False)
    for e in TEXT_ENDINGS:
        known = known | F.lower("source").endswith(e)
    other = files.where(~known).select("source").first()
    if other:
        raise ValueError(f"{other['source']} is neither text nor Markdown")
    return files.select("source", F.decode("content", "UTF-8").alias("text"))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).csv(path)


def write_json(df: DataFrame, path: str, limit: int = 10_000) -> None:
    """A report of at most limit rows as one sorted JSON document; more rows are refused, not cut."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"a report holds at most {limit} rows")
    write_text(df.sparkSession, path, json.dumps([r.asDict(True) for r in rows], indent=2, sort_keys=True, default=str))


def markdown_table(df: DataFrame, title: str, limit: int = 1000) -> str:
    """A small table as Markdown; more rows are refused, not cut."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"a report holds at most {limit} rows")
    show = lambda v: "" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v).replace("|", "\\|")
    lines = [f"## {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join([*lines, *["| " + " | ".join(show(v) for v in r) + " |" for r in rows]]) + "\n"


def report(title: str, tables: dict[str, DataFrame], notes: dict[str, list[str]] | None = None, limit: int = 1000) -> str:
    """A Markdown report: a heading, and for each table its section, headed by its notes."""
    parts = [f"# {title}"]
    for name, df in tables.items():
        lines = [f"- {n}" for n in (notes or {}).get(name, [])]
        heading, _, body = markdown_table(df, name, limit).partition("\n")
        parts.append("\n".join([heading, *(["", *lines] if lines else []), body.rstrip("\n")]))
    return "\n\n".join(parts) + "\n"


def pair_report(spark: SparkSession, sf_dir: str, path: str | None = None) -> str:
    """What the pairs' backtests say: figures, costs, periods, what was concluded, and what is to be run next. Written to path if one is given."""
    from residua.plans.relations import relation

    steps = {"Backtest": "pair_backtest", "Costs": "pair_cost_ladder", "Periods": "pair_period_stability", "Interpretation": "result_interpretation", "Next checks": "tool_plan"}
    tables = {name: relation(spark, sf_dir, s).orderBy("pair") for name, s in steps.items()}
    text = report("Pairs", tables, {"Interpretation": ["No parameter was searched and no holdout opened."]}, limit=100_000)
    if path:
        write_text(spark, path, text)
    return text


def diagnostic_report(spark: SparkSession, sf_dir: str, path: str | None = None) -> str:
    """What the residual diagnostic says: direction, mechanism, continuity, predictability, hypotheses and verdict."""
    from residua.plans.relations import relation

    steps = {"Direction": "direction_tool", "Mechanism": "mechanism_eval", "Continuity": "continuity_audit", "Predictability": "predictability_audit", "Hypotheses": "hypothesis_states", "Verdict": "diagnostic_verdict"}
    tables = {name: relation(spark, sf_dir, s) for name, s in steps.items()}
    tables["Hypotheses"] = tables["Hypotheses"].orderBy("id")
    text = report("Residual diagnostic", tables, {"Mechanism": ["A test in residual space: no execution, no search, no holdout."]})
    if path:
        write_text(spark, path, text)
    return text


def resumed(spark: SparkSession, folder: str, config: dict, origins: list[int], run, block: int = 16) -> DataFrame:
    """Results of run(missing origins) kept per origin below folder; a second call computes only what is missing, `block`
    origins a job. An origin counts once its mark stands. A folder that was begun with another configuration is refused."""
    target, fs = _path(spark, f"{folder}/config.json")
    text = json.dumps(config, sort_keys=True, default=str)
    if fs.exists(target):
        if read_text(spark, f"{folder}/config.json") != text:
            raise ValueError(f"{folder} holds results of another configuration")
    else:
        write_text(spark, f"{folder}/config.json", text)
    missing = [o for o in origins if not fs.exists(_path(spark, f"{folder}/done/{o}")[0])]
    for part in (missing[lo : lo + block] for lo in range(0, len(missing), block)):
        rows = run(part).where(F.col("origin").isin(part))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("origin").parquet(f"{folder}/results")
        for o in part:
            write_text(spark, f"{folder}/done/{o}", "")
    return spark.read.parquet(f"{folder}/results").where(F.col("origin").isin(origins))
