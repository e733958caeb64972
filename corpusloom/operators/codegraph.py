"""Import resolution inside repositories and the resulting code graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.identifiers import module_of_path


def module_table(files: DataFrame) -> DataFrame:
    """(repo, module, path): a package's ``__init__`` file also stands for the package; of
    several files for a module the last in ``ord`` wins."""
    module = module_of_path("path")
    package = F.regexp_replace(module, r"(^|\.)__init__$", "")
    own = files.select("repo", module.alias("module"), "path", "ord")
    packages = files.where(F.endswith("path", F.lit("/__init__.py"))).select("repo", package.alias("module"), "path", "ord")
    return own.unionByName(packages).groupBy("repo", "module").agg(F.max_by("path", F.struct("ord", "path")).alias("path"))


def _ancestors(module: Column) -> Column:
    parts = F.split(module, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "."))


def resolve_imports(files: DataFrame, imports: DataFrame, modules: DataFrame) -> DataFrame:
    """(repo, path, import, target) of the imports that name a file of the repository.

    An absolute import first looks for the very module, then for modules under it or above
    it.  The two-way prefix match is two equi-joins on exploded dotted ancestors.  A relative
    import climbs one directory per leading dot beyond the first and takes the exact file or
    package, else a file below.  Of several candidates a package's ``__init__`` directly
    under the name comes first, then files of the importer's directory, then any, by path.
    """
    folder = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    asked = imports.withColumn("dir", folder)
    relative = F.startswith("import", F.lit("."))
    # relative imports as dotted absolute names
    dots = F.length(F.regexp_extract("import", r"^(\.+)", 1))
    rest = F.regexp_replace("import", r"^\.+", "")
    parts = F.filter(F.split("dir", "/"), lambda x: x != "")
    base = F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - (dots - 1), F.lit(0))), ".")
    wanted = F.when(relative, F.concat_ws(".", F.when(base != "", base), F.when(rest != "", rest))).otherwise(F.col("import"))
    asked = asked.withColumn("wanted", wanted).withColumn("relative", relative).where("wanted <> ''")
    exact = asked.join(modules.select("repo", F.col("module").alias("wanted"), F.col("path").alias("target")), ["repo", "wanted"]).withColumn("rank", F.lit(0))
    left = asked.join(exact.select("repo", "path", "import").distinct(), ["repo", "path", "import"], "left_anti")
    below = modules.select("repo", F.explode(_ancestors(F.col("module"))).alias("wanted"), F.col("path").alias("target"), "module")
    under = left.join(below, ["repo", "wanted"]).where("module <> wanted").drop("module")
    above = left.where("not relative").withColumn("up", F.explode(_ancestors(F.col("wanted")))).join(modules.select("repo", F.col("module").alias("up"), F.col("path").alias("target")), ["repo", "up"]).where("up <> wanted").drop("up")
    near = F.regexp_extract("target", r"^(.*)/[^/]*$", 1) == F.col("dir")
    direct = F.endswith("target", F.concat(F.replace("wanted", F.lit("."), F.lit("/")), F.lit("/__init__.py")))
    ranked = under.unionByName(above).withColumn("rank", F.when(direct, 1).when(near, 2).otherwise(3))
    every = exact.unionByName(ranked).where("target <> path")
    w = Window.partitionBy("repo", "path", "import").orderBy("rank", "target")
    return every.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("repo", "path", "import", "target")


def code_graph(files: DataFrame, resolved: DataFrame, least_links: int = 2) -> DataFrame:
    """Nodes ``repo:path`` with adjacency, for repositories of two rows or more; nodes with
    fewer than ``least_links`` links are left out once, without trimming others' lists."""
    busy = files.groupBy("repo").agg(F.count("*").alias("n")).where("n >= 2").select("repo")
    edges = resolved.select(F.concat_ws(":", "repo", "path").alias("src"), F.concat_ws(":", "repo", "target").alias("dst")).distinct()
    out = edges.groupBy(F.col("src").alias("id")).agg(F.sort_array(F.collect_set("dst")).alias("outgoing"))
    back = edges.groupBy(F.col("dst").alias("id")).agg(F.sort_array(F.collect_set("src")).alias("incoming"))
    nodes = files.join(busy, "repo", "left_semi").select(F.concat_ws(":", "repo", "path").alias("id"), "char_count", "import_count").dropDuplicates(["id"])
    none = F.array().cast("array<string>")
    full = nodes.join(out, "id", "left").join(back, "id", "left").withColumn("outgoing", F.coalesce("outgoing", none)).withColumn("incoming", F.coalesce("incoming", none))
    return full.withColumn("links_in_repo", F.size("outgoing") + F.size("incoming")).where(F.col("links_in_repo") >= least_links)
