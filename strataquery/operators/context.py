"""Evidence packs: what to show for a task within a budget, by role, and what a change touches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataquery.functions.text import impact_role, short_name
from strataquery.operators import lookup, topk
from strataquery.operators.rank import confidence


def pack(hits: DataFrame, budget: int, n: int = 16) -> DataFrame:
    """The first n hits (path, score, cost), filled greedily up to the budget; nothing where the best score is too low."""
    first = hits.orderBy(F.desc("score"), "path").limit(n).withColumn("_all", F.lit(1))
    best = first.agg(F.max("score").alias("best"))
    sure = first.crossJoin(F.broadcast(best)).withColumn("confidence", confidence(F.col("best"))).where("confidence <> 'abstain'").drop("best")  # one row
    return topk.within_budget(sure.withColumn("_at", -F.col("score")), "_all", ["_at", "path"], "cost", budget).drop("_all", "_at")


def smallest_safe_budget(items: DataFrame) -> DataFrame:
    """Per role the cheapest item, and their sum: below it some role is missing."""
    return items.groupBy("role").agg(F.min("cost").alias("cost")).agg(F.sum("cost").alias("budget"), F.count(F.lit(1)).alias("roles"))


def budget_sweep(items: DataFrame, budgets: list[int]) -> DataFrame:
    """(task, budget, items, used, roles, missing, safe) of a packet for each budget, in one pass for all of them.

    items: (task, role, path, cost, gain, mandatory), costs whole numbers from 0. Mandatory items go first, the best of
    each role before the second of any; then the others by gain. A budget takes them in this order while they fit, so
    what it holds only grows with it, and no optional item is held while a mandatory one is missing. A packet is safe when
    it holds a mandatory item of every role that has one; roles counts those held, missing the rest."""
    if not budgets or min(budgets) < 1:
        raise ValueError("budgets are positive numbers")
    turn = F.row_number().over(Window.partitionBy("task", "role", "mandatory").orderBy(F.desc("gain"), "path"))
    ranked = items.withColumn("_kind", F.when(F.col("mandatory"), 0).otherwise(1)).withColumn("_turn", F.when(F.col("mandatory"), turn).otherwise(0)).withColumn("_gain", F.when(F.col("mandatory"), 0).otherwise(-F.col("gain")))
    held = topk.prefix_budget(ranked, ["task"], ["_kind", "_turn", "_gain", "role", "path"], "cost", max(budgets))
    asked = F.explode(F.array(*map(F.lit, sorted(set(budgets)))))
    needs = items.groupBy("task").agg(F.count_distinct(F.when(F.col("mandatory"), F.col("role"))).alias("needed")).withColumn("budget", asked)
    inside = held.withColumn("budget", asked).where("used <= budget")
    sums = inside.groupBy("task", "budget").agg(F.count(F.lit(1)).alias("items"), F.max("used").alias("used"), F.count_distinct(F.when(F.col("mandatory"), F.col("role"))).alias("roles"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    rows = needs.join(sums, ["task", "budget"], "left").select("task", "budget", zero("items"), zero("used"), zero("roles"), "needed")
    return rows.select("task", "budget", "items", "used", "roles", (F.col("needed") - F.col("roles")).alias("missing"), (F.col("needed") == F.col("roles")).alias("safe"))


def by_role(paths: DataFrame, order: list, n: int) -> DataFrame:
    """Paths of each role, the first n, with how many were left out."""
    return topk.with_omissions(paths.withColumn("role", impact_role(F.col("path"))), ["role"], order, n)


def touched_symbols(changes: DataFrame, symbols: DataFrame) -> DataFrame:
    """Symbols that overlap changed line spans (path, from_line, to_line)."""
    return symbols.join(changes, "path").where("start_line <= to_line AND end_line >= from_line").select("path", "qualname").distinct()


def verifiers(changed: DataFrame, edges: DataFrame, n: int) -> DataFrame:
    """Tests that refer to changed paths' targets, most references first."""
    from strataquery.functions.text import is_test_path

    hit = edges.where(is_test_path(F.col("path"))).join(changed.select(F.col("name").alias("target_short")), "target_short", "left_semi")
    return hit.groupBy("path").agg(F.count(F.lit(1)).alias("references")).orderBy(F.desc("references"), "path").limit(n)


def instruction_scope(paths: DataFrame, instructions: DataFrame) -> DataFrame:
    """For each path the instruction files of its folders, deepest first; of one folder an override goes first."""
    rows = instructions.select(F.col("path").alias("instruction"), F.regexp_replace("path", r"(^|/)[^/]+$", "").alias("root"), F.col("path").rlike(r"\.override\.md$").alias("override"))
    from strataquery.functions.text import folder_prefixes

    tried = paths.select("path", F.explode(folder_prefixes(F.col("path"))).alias("root"))
    depth: Column = F.when(F.col("root") == "", 0).otherwise(F.size(F.split("root", "/")))
    return topk.top_per_group(tried.join(rows, "root"), ["path"], [depth.desc(), F.desc("override"), "instruction"], 64, "precedence").select("path", "instruction", "precedence")


def nominations(symbols: DataFrame, names: DataFrame) -> DataFrame:
    """Names with the only symbol that bears them: resolved-unique, ambiguous or unresolved."""
    hit = names.join(symbols.select("name", "path", "qualname"), "name", "left").groupBy("name").agg(F.count("qualname").alias("n"), F.min("qualname").alias("qualname"), F.min("path").alias("path"))
    one = F.col("n") == 1
    return hit.select("name", F.when(F.col("n") == 0, "unresolved").when(one, "resolved-unique").otherwise("ambiguous").alias("status"), F.when(one, F.col("qualname")).alias("qualname"), F.when(one, F.col("path")).alias("path"))


def package_prefix(path: Column, module: Column) -> Column:
    """The package from which a file's relative imports start, with a dot behind it; empty outside of any package."""
    whole = path.rlike(r"(^|/)__init__\.pyi?$")
    package = F.when(whole, module).otherwise(F.substring(module, F.lit(1), F.length(module) - F.length(short_name(module)) - 1))
    parts = F.array_remove(F.split(package, r"\."), "")
    return F.when(F.size(parts) == 0, "").otherwise(F.concat(F.array_join(parts, "."), F.lit(".")))


def absolute_import(target: Column, prefix: Column) -> Column:
    """The dotted name that a relative Python import means: its leading dots are resolved from the package of the importing
    file (`package_prefix`); null where they lead out of it. A module outside of any package imports beside itself."""
    name = F.ltrim(target, F.lit("."))
    ups = F.length(target) - F.length(name) - 1
    parts = F.split(prefix, r"\.")  # the last is empty
    above = F.when(ups < F.size(parts), F.array_join(F.concat(F.slice(parts, F.lit(1), F.size(parts) - 1 - ups), F.array(name)), "."))
    return F.when(target == F.concat(F.lit("."), name), F.concat(prefix, name)).otherwise(above)


def script_paths(imports: DataFrame) -> DataFrame:
    """(source_path, base): the path that a script's relative specifier (source_path, target) names from its file, before any
    ending is tried, with a slash before it; empty where it leads out. Never null, so that a join doesn't work it out twice."""
    steps, parts, last = F.split("target", "/"), F.split("source_path", "/"), F.substring_index("target", "/", -1)
    onward = F.array_remove(steps, "..")
    ups = F.size(steps) - F.size(onward)
    rest = F.array_remove(F.array_remove(onward, "."), "")
    above = F.when(ups < F.size(parts), F.array_join(F.concat(F.slice(parts, F.lit(1), F.size(parts) - 1 - ups), rest), "/"))
    folder = F.substring("source_path", F.lit(1), F.length("source_path") - F.length(F.substring_index("source_path", "/", -1)))
    beside = (F.col("target") == F.concat(F.lit("./"), last)) & ~last.isin("", ".", "..")
    return imports.select("source_path", F.coalesce(F.concat(F.lit("/"), F.when(beside, F.concat(folder, last)).otherwise(above)), F.lit("")).alias("base"))


def import_graph(files: DataFrame, edges: DataFrame, native: DataFrame | None = None) -> DataFrame:
    """File to file (source, target): Python imports, relative ones too, with the module of the longest known prefix (all
    paths of a module that several have); scripts' relative specifiers with the first ending under which there is a file;
    and what a build reports itself (`native`: source, target).

    An import is one row on its way: names are met by what was found for each distinct name, specifiers by the files with
    their endings taken off. Only relative names meet the module of their file."""
    known = files.where("module_name IS NOT NULL")
    modules = known.select(F.col("module_name").alias("module"), F.col("path").alias("target_path"))
    imports = edges.where("kind = 'import'").select(F.col("path").alias("source_path"), "target")
    target = F.col("target")
    script, dotted = target.startswith("./") | target.startswith("../"), target.startswith(".")
    own = imports.where(dotted & ~script).join(known.select(F.col("path").alias("source_path"), package_prefix(F.col("path"), F.col("module_name")).alias("prefix")), "source_path", "left")
    name = F.when(F.col("prefix").isNull(), target).otherwise(absolute_import(target, F.col("prefix")))
    named = imports.where(~dotted).select("source_path", target.alias("name")).union(own.select("source_path", name.alias("name")))
    found = lookup.longest_prefix(named.select("name").distinct(), modules.select("module").distinct(), "name", "module").join(modules, "module")
    pairs = named.join(found.select("name", "target_path"), "name").select("source_path", "target_path")
    scripts = script_paths(imports.where(script)).join(lookup.script_files(files.select(F.col("path").alias("target_path")), "target_path", "base"), "base")
    pairs = pairs.union(scripts.select("source_path", "target_path"))
    if native is not None:
        pairs = pairs.union(native.select("source", "target"))
    return pairs.where("source_path <> target_path").select(F.col("source_path").alias("source"), F.col("target_path").alias("target")).distinct()
