"""Registered queries of what keeps tables up to date and of the sources around them: streams, stamps, archives, prose and addresses, each with its SQL."""

from __future__ import annotations

import io
import uuid
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators.lineage import shared_folder
from ..sources import files, markdown
from ..streaming import incremental
from .engine import Engine
from .generated import frame, sql
from .index import Index
from .queries import query, table

PART = "(SELECT CAST(p_partkey AS BIGINT) AS p, p_name, p_type, p_size FROM part)"


def parts(spark, sf_dir):
    return table(spark, sf_dir, "part").selectExpr("cast(p_partkey as bigint) AS p", "p_name", "p_type", "p_size")


@query("SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def maintained_state(spark, sf_dir):
    """The last event of each user, kept by ``incremental.maintain`` from a stream of three batches; users move between partitions by type."""
    folder = f"{shared_folder(spark)}/maintained-{uuid.uuid4().hex}"
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", F.col("event_type"), "value", "ts", F.col("event_type").alias("kind"))
    for k in range(3):
        rows.filter(F.pmod(F.xxhash64("event_id"), F.lit(3)) == k).write.mode("append").parquet(f"{folder}/feed")
        incremental.maintain(incremental.stream_of(spark, f"{folder}/feed"), f"{folder}/state", f"{folder}/progress", "user_id", ["ts", "event_id"], "kind").awaitTermination()
    return spark.read.parquet(f"{folder}/state").select("user_id", "event_id", "event_type", "value")


@query(f"SELECT p, CASE WHEN p % 3 = 0 THEN p_name ELSE p_type END AS text FROM {PART} q")
def published_table(spark, sf_dir):
    """A table that was published twice: the second one as a whole, in place of the first."""
    target = f"{shared_folder(spark)}/published-{uuid.uuid4().hex}"
    own = parts(spark, sf_dir)
    incremental.publish(own.select("p", F.col("p_name").alias("text")), target)
    incremental.publish(own.select("p", F.when(F.col("p") % 3 == 0, F.col("p_name")).otherwise(F.col("p_type")).alias("text")), target)
    return spark.read.parquet(target)


@query(f"SELECT 'kit' || (p // 20) AS package, count(*) AS n_entries, bool_and((p // 20) % 4 <> 1 OR p % 20 <> 7) AS kept, CAST(0 AS BIGINT) AS second FROM {PART} q GROUP BY 1")
def refreshed_index(spark, sf_dir):
    """An index refreshed twice with the same files, then with one file of every fourth package changed, of equal size: only these packages are
    written again. ``kept`` tells those that are still in the first write, ``second`` how many snapshots the second refresh made."""
    path = f"{shared_folder(spark)}/refreshed-{uuid.uuid4().hex}"
    own = parts(spark, sf_dir).withColumn("k", F.expr("p div 20"))
    text = lambda word: F.concat(F.lit("# Head "), F.col("p").cast("string"), F.lit("\n"), F.lit(word), F.lit(" "), "p_name", F.lit("\n"))
    whole = lambda c: own.select(F.concat(F.lit("kit"), F.col("k").cast("string")).alias("package"), F.concat(F.lit("d"), F.col("p").cast("string"), F.lit(".md")).alias("file"), F.lit("prose").alias("how"), c.alias("text"))
    versions = own.select(F.lit("npm").alias("eco"), F.concat(F.lit("kit"), F.col("k").cast("string")).alias("package"), F.lit("1.0.0").alias("version")).distinct()
    changed = F.when((F.col("k") % 4 == 1) & (F.col("p") % 20 == 7), text("Other")).otherwise(text("About"))
    first = Engine.refresh(whole(text("About")), versions, path)
    again = Engine.refresh(whole(text("About")), versions, path)
    last = Engine.refresh(whole(changed), versions, path)
    index = Index(spark, path)
    before = index.at(first).packages().select("write").distinct().withColumn("kept", F.lit(True))
    written = index.at(last).packages().join(before, "write", "left").select("package", F.coalesce("kept", F.lit(False)).alias("kept"), F.lit(again - first).cast("long").alias("second"))
    return index.at().entries().groupBy("package").agg(F.count("*").alias("n_entries")).join(written, "package")


@query(f"SELECT 'a' || (p // 10) || '.zip' AS archive, 'docs/' || p || '.md' AS file, p_name AS text FROM {PART} q WHERE p % 10 <> 4")
def unpacked_archives(spark, sf_dir):
    """Members of zip archives made of the table, ten rows each; names that leave their archive are passed over, and one archive that can't be read gives none."""

    def zipped(own: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for p, name in zip(own.p, own.p_name, strict=True):
                z.writestr(f"../out/{p}.md" if p % 10 == 4 else f"docs/{p}.md", name)
        return pd.DataFrame({"file": [f"a{own.k.iloc[0]}.zip"], "content": [out.getvalue()]})

    made = parts(spark, sf_dir).withColumn("k", F.expr("p div 10")).select("k", "p", "p_name").groupBy("k").applyInPandas(zipped, "file string, content binary")
    broken = spark.createDataFrame([("broken.zip", bytearray(b"PK no archive"))], "file string, content binary")
    return files.unpack(made.unionByName(broken))


@query(f"""WITH f AS (SELECT p, CASE p % 6 WHEN 0 THEN 'src/_hidden/f' || p || '.py' WHEN 1 THEN 'pkg/internal/f' || p || '.go' WHEN 2 THEN 'lib/__init__.py' WHEN 3 THEN 'plugins/f' || p || '.ts' WHEN 4 THEN 'src/eslint.config.js' ELSE 'src/f' || p || '.ts' END AS file, CASE WHEN p % 5 = 0 THEN 'A._b' ELSE 'A.b' END AS path FROM {PART} q)
SELECT p, p % 6 IN (0, 1) OR p % 5 = 0 AS private, p % 6 IN (3, 4) AS tooling FROM f""")
def path_kinds(spark, sf_dir):
    """Paths of private files and members, and of tools that packages ship."""
    file = F.expr("CASE p % 6 WHEN 0 THEN concat('src/_hidden/f', p, '.py') WHEN 1 THEN concat('pkg/internal/f', p, '.go') WHEN 2 THEN 'lib/__init__.py' WHEN 3 THEN concat('plugins/f', p, '.ts') WHEN 4 THEN 'src/eslint.config.js' ELSE concat('src/f', p, '.ts') END")
    own = parts(spark, sf_dir).withColumns({"file": file, "path": F.when(F.col("p") % 5 == 0, "A._b").otherwise("A.b")})
    return own.select("p", X.private_path(F.col("file"), F.col("path")).alias("private"), X.tooling_path(F.col("file")).alias("tooling"))


@query(f"""SELECT d.eco, d.name, d.version, direct, CASE WHEN s.version IS NULL THEN 'missing' WHEN s.version = d.version THEN 'ready' ELSE 'drift' END AS status, s.version AS found FROM {sql('deps')} d
LEFT JOIN {sql('sources')} s USING (eco, plain) WHERE contains(lower(d.name), 'red') QUALIFY row_number() OVER (PARTITION BY d.eco, d.name ORDER BY s.version <> d.version, priority, s.version) = 1""")
def resolve_filter(spark, sf_dir):
    """``Engine.resolve`` with a filter: indirect dependencies are searched, too."""
    deps = frame(spark, sf_dir, "deps").withColumnRenamed("plain", "norm_name")
    found = Engine(spark, deps, frame(spark, sf_dir, "sources").withColumnRenamed("plain", "norm_name"), spark.createDataFrame([], "package string, version string")).resolve("RED")
    return found.select("eco", "name", "version", "direct", "status", "found")


URL = "CASE p % 8 WHEN 0 THEN 'github:own' || p || '/' || w WHEN 1 THEN 'git+https://github.com/own' || p || '/' || w || '.git#main' WHEN 2 THEN 'git@github.com:own' || p || '/' || w || '.git' WHEN 3 THEN ' own' || p || '/' || w || ' ' WHEN 4 THEN 'https://example.org/own/' || w WHEN 5 THEN './own/' || w WHEN 6 THEN 'https://github.com/own' || p WHEN 7 THEN 'https://github.com/own' || p || '/' || w || '?tab=x~y*z é' END"


@query(f"SELECT p, CASE WHEN p % 8 IN (0, 1, 2, 3, 7) THEN 'own' || p END AS owner, CASE WHEN p % 8 IN (0, 1, 2, 3, 7) THEN w END AS name, CASE WHEN p % 8 = 7 THEN 'https%3A%2F%2Fgithub.com%2Fown' || p || '%2F' || w || '%3Ftab%3Dx~y%2Az%20%C3%A9' END AS escaped FROM (SELECT *, split_part(p_name, ' ', 1) AS w FROM {PART} q)")
def repository_addresses(spark, sf_dir):
    """Repositories that manifests name in several ways, and one address percent-encoded."""
    own = parts(spark, sf_dir).withColumn("w", F.split("p_name", " ")[0]).withColumn("url", F.expr(URL))
    return own.withColumn("r", X.github_repository(F.col("url"))).select("p", F.col("r.owner").alias("owner"), F.col("r.name").alias("name"), F.when(F.col("p") % 8 == 7, X.url_escaped(F.col("url"))).alias("escaped"))


@query(f"""SELECT p, 'Title ' || p || ' › Head ' || p AS name, 'Text of ' || p_name || '.' || chr(10) || chr(10) || chr(10) || 'More.' AS doc, 'page' AS kind FROM {PART} q WHERE p % 2 = 0
UNION ALL SELECT p, 'README › Head ' || p, 'Described as ' || p_type || '.', 'metadata' FROM {PART} q2 WHERE p % 2 = 1""")
def cleaned_prose(spark, sf_dir):
    """Pages with front matter, imports, lines of JSX and badges, and bodies of package metadata: what is left as a section."""
    page = F.expr(r"concat('---\ntitle: Title ', p, '\n---\nimport X from \'y\'\n\n## Head ', p, ' {#id}\n[![build](https://a/b.svg)](https://c)\nText of ', p_name, '.\n<Tabs>\n\nMore.\n')")
    meta = F.expr(r"concat('Name: x\nVersion: 1\n\n# Head ', p, '\nDescribed as ', p_type, '.\n')")
    even = F.col("p") % 2 == 0
    own = parts(spark, sf_dir).select(F.col("p").cast("string").alias("package"), F.when(even, "docs/page.mdx").otherwise("METADATA").alias("file"), F.when(even, "prose").otherwise("metadata").alias("how"), F.when(even, page).otherwise(meta).alias("text"))
    found = markdown.sections(own).filter("doc <> ''")
    return found.select(F.col("package").cast("long").alias("p"), "name", "doc", F.when(F.col("file") == "METADATA", "metadata").otherwise("page").alias("kind"))
