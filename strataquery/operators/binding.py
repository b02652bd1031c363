"""Name binding: calls to the symbols they mean, imports to owners, diagnostics and native claims."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataquery.functions.text import digest, short_name
from strataquery.operators.graph import cut


#: Rules of binding in the order in which they are tried.
RULES = ["self", "local", "named", "import", "unique"]


def bind_calls(calls: DataFrame, symbols: DataFrame, imports: DataFrame, named: DataFrame | None = None, external: DataFrame | None = None) -> DataFrame:
    """Calls (path, source, target, line) with the symbol each means, by the first rule that knows any:

    self (`self.x` in a class of the file), local (a symbol of the file), named (a name that the file imports as such, from
    wherever a facade has it: `named` is path, name, to_path, to_name), import (an imported file's symbol of that name,
    `imports` being file to file), unique (the only symbol of that name anywhere). Several symbols under a rule make the call
    ambiguous; a name whose first part comes from outside (`external`: path, name) is external; else it is unresolved.

    What a call means depends on its file, its short name and whether it is asked of self, so each such question is put
    once. Rules go in stages: each is an equality join on its whole key (file and name; imported file and name) and only what
    it leaves open goes on; the last one meets counts by name, never all symbols of a name."""
    c = calls.withColumn("short", short_name(F.col("target"))).withColumn("of_self", F.col("target").rlike(r"^(self|cls)\.")).withColumn("root", F.substring_index("target", ".", 1))
    key = ["path", "short", "of_self"]
    open_ = cut(c.select(*key).distinct())
    s = symbols.select(F.col("path").alias("to_path"), F.col("name").alias("short"), F.col("qualname").alias("to")).distinct()
    here = s.withColumnRenamed("to_path", "path")
    means = [F.count(F.lit(1)).alias("n"), F.min("to_path").alias("to_path"), F.min("to").alias("to")]
    stages = {
        "self": lambda o: o.where("of_self").join(here.where(F.col("to").contains(".")), ["path", "short"]).withColumn("to_path", F.col("path")),
        "local": lambda o: o.join(here, ["path", "short"]).withColumn("to_path", F.col("path")),
        "named": lambda o: o.join(named.select("path", F.col("name").alias("short"), "to_path", F.col("to_name").alias("_name")).distinct(), ["path", "short"]).join(s.withColumnRenamed("short", "_name"), ["to_path", "_name"]),
        "import": lambda o: o.join(imports.select(F.col("source").alias("path"), F.col("target").alias("to_path")).distinct(), "path").join(s, ["to_path", "short"]),
    }
    found = []
    for rule, stage in stages.items():
        if rule == "named" and named is None:
            continue
        done = cut(stage(open_).select(*key, "to_path", "to").distinct().groupBy(*key).agg(*means).withColumn("rule", F.lit(rule)))
        found.append(done)
        open_ = cut(open_.join(done.select(*key), key, "left_anti"))
    by_name = s.groupBy("short").agg(*means)
    found.append(open_.join(by_name, "short").select(*key, "n", "to_path", "to", F.lit("unique").alias("rule")))
    out = c.join(reduce(DataFrame.unionByName, found), key, "left")
    if external is not None:
        out = out.join(external.select("path", F.col("name").alias("root"), F.lit(True).alias("_out")).distinct(), ["path", "root"], "left")
    status = F.when(F.col("n").isNull() & (F.col("_out") if external is not None else F.lit(False)), "external").when(F.col("n").isNull(), "unresolved").when(F.col("n") > 1, "ambiguous").otherwise("resolved")
    sure = F.col("n") == 1
    return out.select("path", "source", "target", "line", status.alias("status"), "rule", F.when(sure, F.col("to_path")).alias("to_path"), F.when(sure, F.col("to")).alias("to"))


def diagnostics(rows: DataFrame) -> DataFrame:
    """Tool diagnostics (tool, rule, path, symbol, message, line, column) with an identity of all they say."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("tool", "rule", "path", "symbol", "message", "line", "column")]
    return rows.withColumn("identity", digest(*parts, domain="diagnostic")).dropDuplicates(["identity"])


def stage_occurrences(occurrences: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Definitions, references to symbols that are defined here, and references to others (unlocated)."""
    defined = occurrences.where("role = 'definition'").select("path", "symbol", "line").distinct()
    refs = occurrences.where("role = 'reference'").groupBy("path", "symbol", "line").agg(F.count(F.lit(1)).alias("n"))
    known = defined.select("symbol").distinct()
    return defined, refs.join(known, "symbol", "left_semi"), refs.join(known, "symbol", "left_anti")


def claims(target: str, *sources: tuple[str, DataFrame]) -> DataFrame:
    """Relationship claims of several producers about one target, side by side."""
    out = None
    for producer, df in sources:
        own = df.where(F.col("symbol") == target).select("path", "line", F.lit(producer).alias("producer"))
        out = own if out is None else out.union(own)
    return out.groupBy("path", "line").agg(F.array_join(F.array_sort(F.collect_set("producer")), ",").alias("producers"))


def literal_readers(files: DataFrame, tests_only: bool = True) -> DataFrame:
    """(path, asset): files that name another file of the collection by a quoted literal."""
    from strataquery.functions.text import is_test_path

    rows = files.where(is_test_path(F.col("path"))) if tests_only else files
    quoted = rows.select("path", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"""["']([A-Za-z0-9_./-]+\.[A-Za-z0-9]+)["']"""), F.lit(1)))).alias("asset"))
    return quoted.join(files.select(F.col("path").alias("asset")), "asset", "left_semi").select("path", "asset")
