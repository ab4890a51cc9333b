"""Dependencies that manifests declare, as rows; nothing of them is executed or resolved."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnwork.functions import text as T

#: Sections of a package manifest and what they are.
SECTIONS = {"dependencies": "runtime", "devDependencies": "development", "peerDependencies": "peer", "optionalDependencies": "optional"}
REQUIREMENT = r"^([A-Za-z0-9][A-Za-z0-9._-]*)(?:\[[^\]]*\])?\s*((?:[<>=!~]=?|===)[^;#]*)?\s*(?:[;#].*)?$"
GO_REQUIRE = r"(?m)^\s*(?:require\s+)?([a-z0-9.-]+\.[a-z]+/[^\s()]+)\s+(v[^\s()]+)"


def dependencies(files: DataFrame) -> DataFrame:
    """(path, ecosystem, target, identity, category, constraint, source) of files (path, text): package.json, requirements*.txt, go.mod.

    URLs, local paths, editable and malformed entries are left out.
    """
    name = T.base_name(F.col("path"))
    js = files.filter(name == "package.json").withColumn("m", F.from_json("text", "struct<" + ", ".join(f"{s}: map<string, string>" for s in SECTIONS) + ">"))
    found = []
    for section, category in SECTIONS.items():
        rows = js.filter(F.col(f"m.{section}").isNotNull()).select("path", F.explode(f"m.{section}").alias("target", "constraint"))
        rows = rows.filter(~F.col("constraint").rlike("^(file:|link:|git|https?:)"))
        found.append(rows.select("path", F.lit("npm").alias("ecosystem"), "target", F.lit(category).alias("category"), "constraint", F.lit(section).alias("source")))
    lines = files.filter(name.rlike(r"^requirements[^/]*\.txt$")).select("path", F.explode(F.split("text", "\r?\n")).alias("line"))
    lines = lines.select("path", F.trim("line").alias("line")).filter(F.col("line").rlike(REQUIREMENT))
    normal = F.regexp_replace(F.lower(F.regexp_extract("line", REQUIREMENT, 1)), "[-_.]+", "-")
    found.append(lines.select("path", F.lit("pypi").alias("ecosystem"), normal.alias("target"), F.lit("runtime").alias("category"), F.trim(F.regexp_extract("line", REQUIREMENT, 2)).alias("constraint"), F.lit("requirements").alias("source")))
    go = files.filter(name == "go.mod").select("path", F.explode(F.arrays_zip(F.regexp_extract_all("text", F.lit(GO_REQUIRE), 1).alias("t"), F.regexp_extract_all("text", F.lit(GO_REQUIRE), 2).alias("v"))).alias("z"))
    found.append(go.select("path", F.lit("go").alias("ecosystem"), F.col("z.t").alias("target"), F.lit("runtime").alias("category"), F.col("z.v").alias("constraint"), F.lit("require").alias("source")))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.withColumn("identity", F.concat_ws(":", F.lit("dependency"), "ecosystem", "target")).distinct()
