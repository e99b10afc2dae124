"""Named relational steps. A step is a SELECT over other steps and base tables; a query is a step with all it needs.

The same declarative text is planned by Catalyst here and rendered as one statement for any other SQL engine. Text in
<<...>> is written per dialect by MACROS.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import store
from .store import stored

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
STEPS: dict[str, str] = {}
#: Steps as Spark runs them where no own frames are given: the same rows by a way that moves less; STEPS says what they are.
LEAN: dict[str, str] = {}
#: Parts of LEAN that are made of a step's DataFrame by a function: name to (step, function).
MADE: dict[str, tuple[str, Callable[[DataFrame], DataFrame]]] = {}

MACROS: dict[str, dict[str, str]] = {
    "spark": {
        "series": r"(SELECT id AS i FROM range(\1))",
        "tokens": r"regexp_extract_all(lower(\1), '[a-z][a-z0-9_-]+', 0)",
        "unnest": r"explode(\1)",
        "dot": r"aggregate(zip_with(\1, \2, (a, b) -> CAST(a AS DOUBLE) * CAST(b AS DOUBLE)), CAST(0 AS DOUBLE), (s, v) -> s + v)",
        "list": r"array(\1)",
        "has": r"contains(\1, \2)",
        "flat": r"regexp_replace(\1, '[\\x20\\x09-\\x0D]+', ' ')",
        "join": r"array_join(array_sort(collect_list(\1)), ',')",
        "int": r"try_cast(\1 AS INT)",
        "dbl": r"try_cast(nullif(\1, '') AS DOUBLE)",
        "div": r"((\1) div (\2))",
        "collect": r"collect_list(\1)",
        "item": r"\1[CAST(\2 AS INT)]",
    },
    "duckdb": {
        "series": r"(SELECT range AS i FROM range(\1))",
        "tokens": r"regexp_extract_all(lower(\1), '[a-z][a-z0-9_-]+')",
        "unnest": r"unnest(\1)",
        "dot": r"list_dot_product(CAST(\1 AS DOUBLE[]), CAST(\2 AS DOUBLE[]))",
        "list": r"[\1]",
        "has": r"contains(\1, \2)",
        "flat": r"regexp_replace(\1, '[\x20\x09-\x0D]+', ' ', 'g')",
        "join": r"array_to_string(list_sort(list(\1)), ',')",
        "int": r"TRY_CAST(\1 AS INT)",
        "dbl": r"TRY_CAST(nullif(\1, '') AS DOUBLE)",
        "div": r"((\1) // (\2))",
        "collect": r"list(\1)",
        "item": r"\1[\2 + 1]",
    },
}


def step(name: str, sql: str) -> None:
    """Registers a step. PER_YEAR stands for the number of rows that a year has, which the step `pace` states."""
    STEPS[name] = sql.strip().replace("PER_YEAR", "(SELECT per_year FROM pace)")


def lean(name: str, sql: str) -> None:
    """Registers the way a step is run here, or a part of such a way that only Spark needs."""
    LEAN[name] = sql.strip().replace("PER_YEAR", "(SELECT per_year FROM pace)")


def _dialect(sql: str, dialect: str) -> str:
    def write(m: re.Match) -> str:
        name, args = m[1], m[2].split(" ;; ")
        out = MACROS[dialect][name]
        for i, a in enumerate(args, 1):
            out = out.replace(f"\\{i}", a)
        return out

    inner = re.compile(r"<<(\w+) ((?:(?!<<|>>).)*)>>", re.S)  # innermost first
    while inner.search(sql):
        sql = inner.sub(write, sql)
    return re.sub(r"(?<![\w.'])(\d+\.\d+)(?![\w.'])", r"\1e0", sql)  # doubles, not decimals


def _words(sql: str) -> list[str]:
    return re.findall(r"\b(?:FROM|JOIN)\s+([a-z]\w*)\b", sql)


def _needs(name: str, seen: list[str], texts: dict[str, str]) -> list[str]:
    if name not in seen:
        for word in _words(texts[name]):
            if word in texts and word != name:
                _needs(word, seen, texts)
        seen.append(name)
    return seen


def render(name: str, dialect: str = "duckdb", texts: dict[str, str] | None = None) -> str:
    """One statement for the step: its parts as common table expressions."""
    texts = STEPS if texts is None else texts
    *parts, last = _needs(name, [], texts)
    body = _dialect(texts[last], dialect)
    return f"WITH {', '.join(f'{p} AS ({_dialect(texts[p], dialect)})' for p in parts)}\n{body}" if parts else body


#: Steps written once per folder: what several later steps start from. Those with symbols lie in buckets of symbols.
KEPT = "cell calendar members book_totals direction_tool mechanism_eval continuity_audit continuity_days predictability_audit ic_days panel pair_metrics mapped resid held held_days threshold_positions ranked buffered reversal_days mechanism_days bt_days scaled tf idf".split()

#: Those of them that Python makes of lists of symbols: Spark does not see that their rows still lie where their symbol is.
DEALT = ("held", "threshold_positions")


def relation(spark: SparkSession, sf_dir: str, name: str, **frames: DataFrame) -> DataFrame:
    """The step as a DataFrame over the tables in sf_dir; frames replaces base tables or steps by DataFrames of one's own.

    Base tables are read as Parquet scans, so column pruning and filters reach the files. Without own frames, the steps in
    KEPT that this one needs are written once and read back.
    """
    if name not in STEPS and (frames or name not in LEAN):
        raise KeyError(f"{name} is no step")
    for given, df in frames.items():
        if given not in STEPS and given not in TABLES:
            raise ValueError(f"{given} is neither a table nor a step")
        if not isinstance(df, DataFrame):
            raise TypeError(f"{given} must be a DataFrame")
    own, texts = dict(frames), STEPS if frames else STEPS | LEAN
    if not frames:
        spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")  # sides dealt by symbol alone may be joined by date and symbol
        spark.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")  # a bucket is one file in the order of its rows
        needs = _needs(name, [], texts)
        used = {k for k in KEPT if k in needs and k != name}
        inner = {d for k in used for d in _needs(k, [], texts) if d != k and d in used}  # reached through other kept steps only?
        direct = used - inner | {d for d in inner if _reaches(name, d, used, texts)}
        # those that start from a dealt step come last: what such a step is made of may lie written by then
        order = sorted(direct, key=lambda k: (not {k, *_needs(k, [], texts)}.isdisjoint(DEALT), k))
        own = {k: stored(spark, sf_dir, k, lambda k=k: _kept(spark, sf_dir, k), dealt=k in DEALT) for k in order}
        if name in KEPT and store.known(spark, sf_dir, name):
            return stored(spark, sf_dir, name, None)
    sql = render(name, "spark", {k: v for k, v in texts.items() if k not in own or k == name})
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if t not in own and re.search(rf"\b(FROM|JOIN)\s+{t}\b", sql)}
    used |= {k: made(relation(spark, sf_dir, source)) for k, (source, made) in MADE.items() if not frames and re.search(rf"\bFROM\s+{k}\b", sql)}
    used |= {k: v for k, v in own.items() if re.search(rf"\b(FROM|JOIN)\s+{k}\b", sql)}
    sql = re.sub(r"[{}]", lambda m: m[0] * 2, sql)
    parts = ", ".join(f"{t} AS (SELECT * FROM {{{t}}})" for t in sorted(used))
    if parts:
        sql = f"WITH {parts}, {sql.removeprefix('WITH ')}" if sql.startswith("WITH ") else f"WITH {parts}\n{sql}"
    return spark.sql(sql, **used)


def _kept(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A kept step's plan; the trades are dealt by symbol once, and all that follows stays where its symbol is."""
    if name != "cell":
        return relation(spark, sf_dir, name)
    return relation(spark, sf_dir, name, trades=relation(spark, sf_dir, "trades").repartition(store.buckets(spark, sf_dir), "symbol"))


def _reaches(name: str, wanted: str, kept: set[str], texts: dict[str, str]) -> bool:
    """Whether name needs wanted by a way that leads through no other kept step."""
    for word in _words(texts[name]):
        if word == wanted or (word in texts and word != name and word not in kept and _reaches(word, wanted, kept, texts)):
            return True
    return False
