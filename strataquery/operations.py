"""Operations by name over an `Engine`: one contract for library calls, the command line and cached results.

    python -m strataquery INDEX find '{"query": "rail yard", "n": 5}'
"""

from __future__ import annotations

import hashlib
import inspect
import json
import threading
from collections.abc import Callable
from concurrent.futures import Future
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataquery.engine import Engine
from strataquery.sources.generations import Generations

#: The operations that the contract names: columns that every answer has, and whether the answer is bounded.
CONTRACT: dict[str, tuple[tuple[str, ...], bool]] = {
    "stats": (("name", "n"), True),
    "languages": (("language", "n"), True),
    "symbol": (("path", "qualname"), True),
    "outline": (("path", "qualname", "start_line"), False),
    "read": (("path", "line", "content"), False),
    "source": (("path", "start_line", "end_line", "text"), False),
    "grep": (("path", "line", "content", "truncated"), True),
    "refs": (("path", "source", "target", "line", "truncated"), True),
    "enclosing": (("path", "qualname", "width"), False),
    "find": (("path", "score"), True),
    "find_task": (("path", "score", "route"), True),
    "import_owner": (("path", "name", "status"), True),
    "imports": (("source", "target"), False),
    "affected": (("node", "depth"), False),
    "affected_tests": (("node", "depth"), False),
    "impact": (("role", "path"), True),
    "neighbours": (("neighbour", "weight"), False),
    "context_pack": (("path", "score", "cost"), True),
    "findings": (("path", "kind"), False),
    "digests": (("path",), False),
    "action_map": (("role", "path", "score"), True),
    "brief": (("section", "path"), True),
    "verifiers": (("path", "verifier", "distance"), False),
}
SCHEMA = "strataquery.{op}.v1"


def schema_of(op: str) -> str:
    if op not in CONTRACT:
        raise ValueError(f"no operation named {op}")
    return SCHEMA.format(op=op)


def call(engine: Engine, op: str, **args: Any) -> DataFrame:
    """An operation's answer, after its arguments and before its columns have been held against the contract."""
    schema_of(op)
    run = getattr(engine, op)
    try:
        inspect.signature(run).bind(**args)
    except TypeError as e:
        raise ValueError(f"{op}: {e}") from e
    out = run(**args)
    lacking = set(CONTRACT[op][0]) - set(out.columns)
    if lacking:
        raise RuntimeError(f"{op} lacks {', '.join(sorted(lacking))}")
    return out


def action_key(generation: int, op: str, args: dict[str, Any]) -> str:
    """The identity of a question: the same for the same generation, operation and arguments, in any order."""
    return hashlib.sha256(json.dumps([generation, schema_of(op), args], sort_keys=True, separators=(",", ":")).encode()).hexdigest()


class Results:
    """Answers kept by their question's key, as Parquet below `path`; a generation's answers never change.

    Callers that ask the same at the same time share one computation."""

    def __init__(self, engine: Engine, generation: int, path: str) -> None:
        self.engine, self.generation, self.path = engine, generation, path.rstrip("/")
        self._running: dict[str, Future] = {}
        self._lock = threading.Lock()
        self.hits = self.misses = self.shared = 0

    def _stored(self, at: str) -> bool:
        spark = self.engine.spark
        p = spark._jvm.org.apache.hadoop.fs.Path(f"{at}/_SUCCESS")
        return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)

    def get(self, op: str, **args: Any) -> DataFrame:
        key = action_key(self.generation, op, args)
        at = f"{self.path}/{key}"
        with self._lock:
            own = key not in self._running
            if own:
                self._running[key] = Future()
            else:
                self.shared += 1
            future = self._running[key]
        if own:
            try:
                if self._stored(at):
                    self.hits += 1
                else:
                    self.misses += 1
                    call(self.engine, op, **args).write.mode("overwrite").parquet(at)
                future.set_result(at)
            except BaseException as e:
                future.set_exception(e)
            finally:
                with self._lock:
                    del self._running[key]
        return self.engine.spark.read.parquet(future.result())


def economics(engine: Engine, answers: dict[str, DataFrame]) -> DataFrame:
    """Per answer: rows, bytes of its JSON, tokens of that, and its share of the whole index in tokens."""
    whole = engine.files.agg(F.sum("full_tokens").alias("whole"))
    out = None
    for name, df in sorted(answers.items()):
        size = F.octet_length(F.to_json(F.struct(*df.columns)))
        one = df.agg(F.lit(name).alias("answer"), F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes"))
        out = one if out is None else out.union(one)
    if out is None:
        raise ValueError("no answers")
    tokens = F.ceil(F.col("bytes") / 4).cast("long")
    return out.crossJoin(F.broadcast(whole)).select("answer", "n_rows", "bytes", tokens.alias("tokens"), F.round(tokens / F.greatest("whole", F.lit(1)), 6).alias("share"))  # one row


def intelligence(engine: Engine, surface: str, before: Engine | None = None, recorded: DataFrame | None = None, **args: Any) -> DataFrame:
    """One entry for snapshot, profile, freshness, delta and explain."""
    from strataquery.operators import rank

    def needed(x: Any, name: str) -> Any:
        if x is None:
            raise ValueError(f"{surface} needs {name}")
        return x

    surfaces: dict[str, Callable[[], DataFrame]] = {
        "snapshot": lambda: engine.files.select("path", "language", "file_digest", "full_tokens"),
        "profile": lambda: engine.files.groupBy("language").agg(F.count(F.lit(1)).alias("files"), F.sum("full_tokens").alias("tokens")),
        "freshness": lambda: engine.freshness(needed(recorded, "recorded digests")),
        "delta": lambda: engine.delta(needed(before, "an engine before")),
        "explain": lambda: engine.spark.createDataFrame([(k, json.dumps(v)) for k, v in rank.route(needed(args.get("query"), "a query")).items()], "part string, value string"),
    }
    if surface not in surfaces:
        raise ValueError(f"no surface named {surface}")
    return surfaces[surface]()


def main(argv: list[str]) -> int:
    """Prints the rows of an operation over the newest generation of an index, one JSON object a line."""
    from strataquery.session import local_session

    if len(argv) < 2:
        print(__doc__ + "\nOperations: " + ", ".join(CONTRACT))
        return 2
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    try:
        engine = Engine.load(spark, argv[0])
        for row in call(engine, argv[1], **(json.loads(argv[2]) if len(argv) > 2 else {})).toJSON().toLocalIterator():
            print(row)
    except ValueError as e:
        print(e)
        return 1
    return 0


def newest(engine: Engine, index: str, results: str) -> Results:
    return Results(engine, Generations(engine.spark, index).current(), results)
