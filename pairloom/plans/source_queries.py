"""Queries over sources, sinks and resumable state: tables are written to the shared folder in a format and
read back, so their SQL is that of the table."""

from __future__ import annotations

import io
import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.operators import quality as Q
from pairloom.operators import sampling
from pairloom.plans.registry import query
from pairloom.session import shared_path, table
from pairloom.sources import readers, writers
from pairloom.streaming import external, models, resume


def _one_document(df: DataFrame, path: str) -> None:
    """A small table as one JSON array in one file."""
    writers.write_text(df.sparkSession, path, "[" + ",".join(df.toJSON().collect()) + "]")


@query(
    "SRC1 SRC3 ARR2",
    """select 'nation_' || n_nationkey as question_id, n_name as question, f.i as file_idx, case when f.i = 0 then 'sex' else 'age' end as kind, case when f.i = 0 then 'about ' || n_name else 'u' || n_name end as text
from nation, (values (0), (1)) as f(i) where f.i = 0 or n_regionkey < 2""",
)
def json_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    root, nation = shared_path(spark, "json"), table(spark, sf_dir, "nation")
    key = F.concat(F.lit("nation_"), F.col("n_nationkey").cast("string")).alias("question_id")
    original = F.struct(F.col("n_name").alias("question"), F.lit("A").alias("answer_idx")).alias("original")
    flat = F.struct(F.array(F.struct(F.lit("sex").alias("intervention_type"), F.concat(F.lit("about "), "n_name").alias("text"))).alias("variants"))
    nested = F.struct(F.struct(F.struct(F.struct(F.concat(F.lit("u"), "n_name").alias("text")).alias("young")).alias("age")).alias("variants"))
    _one_document(nation.select(key, original, flat.alias("counterfactuals")), f"{root}/a.json")
    _one_document(nation.where("n_regionkey < 2").select(key, original, nested.alias("counterfactuals")), f"{root}/b.json")
    rows = readers.read_records(spark, [f"{root}/a.json", f"{root}/b.json"])
    return rows.select("question_id", "original.question", "file_idx", F.explode("variants").alias("v")).select("question_id", "question", "file_idx", F.col("v.intervention_type").alias("kind"), "v.text")


@query("SRC2", "select 'list' as layout, r_regionkey, r_name from region union all select 'object', r_regionkey, r_name from region")
def list_or_object(spark, sf_dir):
    root, rows = shared_path(spark, "records"), [r.asDict() for r in table(spark, sf_dir, "region").select("r_regionkey", "r_name").collect()]
    writers.write_text(spark, f"{root}/l.json", json.dumps(rows))
    writers.write_text(spark, f"{root}/o.json", json.dumps({str(r["r_regionkey"]): r for r in rows}))
    kind = "struct<r_regionkey:bigint,r_name:string>"
    parts = [readers.records_of(spark, f"{root}/{n}.json", kind).select(F.lit(name).alias("layout"), "*") for n, name in (("l", "list"), ("o", "object"))]
    return parts[0].unionByName(parts[1])


@query("SRC4", "select 'part_test_' || p_partkey as question_id, p_name from part where p_partkey % 5 = 0")
def split_rows(spark, sf_dir):
    path = shared_path(spark, "splits")
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("idx"), "p_name", F.when(F.col("p_partkey") % 5 == 0, "test").otherwise("train").alias("split"))
    writers.write_parquet(part, path)
    return readers.read_split(spark, path, "test", "part").select("question_id", "p_name")


@query("SRC5 SNK1", "select s_suppkey, s_name, round(s_acctbal, 2) as s_acctbal from supplier where s_nationkey % 2 = 1")
def csv_split(spark, sf_dir):
    path = shared_path(spark, "csv")
    rows = table(spark, sf_dir, "supplier").withColumn("split", F.when(F.col("s_nationkey") % 2 == 1, "odd").otherwise("even"))
    writers.write_csv(rows.select("s_suppkey", F.concat("s_name", F.lit(', "x"\n')).alias("quoted"), "s_name", "s_acctbal", "split"), path, drop=("quoted",), first=("split",))
    return readers.read_csv(spark, path, "split string, s_acctbal double, s_name string, s_suppkey bigint", "odd").select("s_suppkey", "s_name", F.round("s_acctbal", 2).alias("s_acctbal"))


@query("SNK3 ARR14", "select 'r_name,r_regionkey,n_name,nested,zz' as header, 'r_name,zz,r_regionkey,n_name,nested' as of_keys, count(*) as n from nation")
def csv_columns(spark, sf_dir):
    from pairloom.plans.experiments import key_union

    path = shared_path(spark, "csv-columns")
    one = table(spark, sf_dir, "region").select(F.lit("z").alias("zz"), "r_regionkey", "r_name")
    two = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("r_regionkey"), "n_name", F.array("n_nationkey").alias("nested"))
    both = two.join(one, "r_regionkey")
    writers.write_csv(both, path, first=("r_name", "r_regionkey"))
    found = spark.read.option("header", True).csv(path)
    keys = key_union([one, two], ["r_name"])
    return found.agg(F.lit(",".join(found.columns)).alias("header"), F.lit(",".join(keys)).alias("of_keys"), F.count("*").alias("n"))


@query("SRC6", "select r_name as task_name, n_nationkey as a, n_name as b from nation join region on n_regionkey = r_regionkey")
def task_folders(spark, sf_dir):
    root = shared_path(spark, "tasks")
    rows = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("r_name", "n_nationkey", "n_name").collect()  # 25 rows
    for name in sorted({r.r_name for r in rows}):
        writers.write_text(spark, f"{root}/{name}/train.tsv", "a\tb\n" + "".join(f"{r.n_nationkey}\t{r.n_name}\n" for r in rows if r.r_name == name))
    return readers.read_task_folders(spark, root, "a bigint, b string").select(F.regexp_replace("task_name", "%20", " ").alias("task_name"), "a", "b")


@query("SRC8 SNK4", "select event_id, case when event_id % 7 <> 0 then value end as value from events where event_id % 3 <> 0")
def jsonl_success(spark, sf_dir):
    path = shared_path(spark, "jsonl")
    value = F.when(F.col("event_id") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    writers.write_json(table(spark, sf_dir, "events").select("event_id", value.alias("value"), (F.col("event_id") % 3 != 0).alias("success")), path)
    return readers.read_jsonl(spark, path, "success boolean, event_id bigint, value double", True).select("event_id", "value")


@query("SRC9 SRC10 SNK5", "select 'item' || i as item, cast(l as varchar) as layer, cast(i * 100 + l * 10 as double) as first, cast(i * 100 + l * 10 + 1 as double) as second from range(6) as a(i), range(4) as b(l)")
def npz_axes(spark, sf_dir):
    path, data = f"{shared_path(spark, 'npz')}/cube.npz", io.BytesIO()
    i, layer, dim = np.indices((6, 4, 2))
    np.savez(data, acts=(i * 100 + layer * 10 + dim).astype(float), item=np.array([f"item{k}" for k in range(6)]))
    writers.write_text(spark, path, data.getvalue())
    return readers.read_npz(spark, path, "acts", ["item", "layer", "dim"]).select("item", "layer", F.get("vec", F.lit(0)).alias("first"), F.get("vec", F.lit(1)).alias("second"))


@query(
    "SRC11 SRC14 SNK8",
    """select c_mktsegment as kind, count(*) as n, round(sum(c_acctbal), 2) as total, (select round(c_acctbal, 2) from customer where c_custkey = 7) as of_seven, (select count(*) from customer) as in_shards from customer group by 1""",
)
def sharded_store(spark, sf_dir):
    root = shared_path(spark, "store")
    rows = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("kind"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("key"), F.col("c_acctbal").alias("x"))
    writers.write_parquet(rows, f"{root}/results", by=("kind",), rows_per_file=100)
    writers.write_parquet(rows.select(F.col("key").alias("pair_key"), "kind"), f"{root}/pair_metadata")
    store = readers.ShardedStore(spark, root)
    kinds = [r.kind for r in store.pairs().select("kind").distinct().collect()]  # five segments
    seven = None
    parts = []
    for kind in sorted(kinds):
        found = store.get(kind, "c7").select("x")
        seven = found if seven is None else seven.union(found)
        parts.append(store.results(kind).agg(F.lit(kind).alias("kind"), F.count("*").alias("n"), F.round(F.sum("x"), 2).alias("total")))
    every = parts[0]
    for p in parts[1:]:
        every = every.union(p)
    one = seven.agg(F.round(F.max("x"), 2).alias("of_seven")).crossJoin(store.shards().agg(F.sum("n_keys").alias("in_shards")))
    return every.crossJoin(F.broadcast(one))  # one row


@query("SRC12", "select r_name as kind, length(r_name) + 6 as n from region")
def readme_fields(spark, sf_dir):
    root = shared_path(spark, "readme")
    for r in table(spark, sf_dir, "region").collect():  # five rows
        writers.write_text(spark, f"{root}/{r.r_regionkey}.md", f"# Task\n\nReasoning type: {r.r_name}\nComment: about {r.r_name}\n")
    return readers.read_fields(spark, f"{root}/*.md", {"kind": r"Reasoning type: ([^\n]+)", "said": r"Comment: ([^\n]*)"}).select("kind", F.length("said").alias("n"))


ORDER_SCHEMA = {
    "properties": {
        "id": {"type": "string", "pattern": "^o_[0-9]+$"},
        "status": {"enum": ["F", "O"]},
        "price": {"type": "object", "properties": {"total": {"type": "number", "minimum": 1000, "maximum": 200000}}},
        "clerk": {"type": "string"},
    },
    "required": ["id", "clerk"],
}


@query(
    "SRC13 DQ1",
    """select * from (select 'status' as field, 'not in enumeration' as message, count(*) as n from orders where o_orderstatus not in ('F', 'O')
union all select 'price.total', 'below minimum', count(*) from orders where o_totalprice < 1000 union all select 'price.total', 'above maximum', count(*) from orders where o_totalprice > 200000
union all select 'clerk', 'missing', count(*) from orders where o_orderkey % 10 = 0 union all select 'id', 'pattern', count(*) from orders where o_orderkey % 7 = 0) where n > 0""",
)
def schema_violations(spark, sf_dir):
    path = f"{shared_path(spark, 'schema')}/schema.json"
    writers.write_text(spark, path, json.dumps(ORDER_SCHEMA))
    key = F.col("o_orderkey").cast("string")
    made = F.to_json(F.struct(
        F.concat(F.when(F.col("o_orderkey") % 7 == 0, "x_").otherwise("o_"), key).alias("id"), F.col("o_orderstatus").alias("status"),
        F.struct(F.col("o_totalprice").alias("total")).alias("price"), F.when(F.col("o_orderkey") % 10 != 0, F.lit("c")).alias("clerk"),
    ))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", made.alias("j"))
    return Q.schema_issues(rows, "j", readers.read_schema(spark, path), ["o_orderkey"]).groupBy("field", "message").agg(F.count("*").alias("n"))


@query("SRC15", "select p_partkey, case when p_partkey % 4 <> 0 then p_size end as p_size, p_brand from part")
def csv_index(spark, sf_dir):
    path = shared_path(spark, "index")
    size = F.when(F.col("p_partkey") % 4 == 0, F.lit("n/a")).otherwise(F.col("p_size").cast("string"))
    writers.write_csv(table(spark, sf_dir, "part").select("p_partkey", size.alias("p_size"), "p_brand"), path)
    return readers.read_index(spark, path, ["p_partkey", "p_size"]).select(F.col("p_partkey").cast("bigint").alias("p_partkey"), "p_size", "p_brand")


@query("SNK2 SRC7", "select l_returnflag, l_linestatus, count(*) as n, round(sum(l_extendedprice), 2) as total from lineitem where l_returnflag <> 'A' group by 1, 2")
def parquet_copies(spark, sf_dir):
    path = shared_path(spark, "copy")
    writers.write_parquet(table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_extendedprice"), path, by=("l_returnflag",))
    back = readers.read_parquet(spark, path, ["l_returnflag", "l_linestatus", "l_extendedprice"], F.col("l_returnflag") != "A")
    return back.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("total"))


@query("SNK6 SNK7", "select r_regionkey, r_name, 'second' as note from region")
def versions(spark, sf_dir):
    root = shared_path(spark, "versions")
    kept, region = writers.Versions(spark, root), table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    kept.write(region.limit(2))
    kept.write(region)
    writers.write_text(spark, f"{root}/note", "first")
    writers.write_text(spark, f"{root}/note", "second")
    return kept.read().withColumn("note", F.lit(writers.read_text(spark, f"{root}/note")))


@query("SNK9", "select o_orderpriority as family, 'a1' as experiment, count(*) as n, round(avg(o_totalprice), 4) as mean from orders group by 1")
def experiment_folders(spark, sf_dir):
    root, orders = shared_path(spark, "experiments"), table(spark, sf_dir, "orders")
    for r in orders.select("o_orderpriority").distinct().collect():  # five priorities
        own = orders.where(F.col("o_orderpriority") == r[0]).select("o_orderkey", "o_totalprice")
        writers.write_experiment(root, r[0], "a1", {"per_pair": own, "aggregate": own.agg(F.count("*").alias("n"))}, {"family": r[0]})
    back = spark.read.option("basePath", root).parquet(f"{root}/*/*/per_pair")
    return back.groupBy("family", "experiment").agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean"))


@query("SNK10", "select 'regions' as section, 'name' as key, r_name as value from region union all select 'regions', 'key', cast(r_regionkey as varchar) from region")
def text_report(spark, sf_dir):
    return writers.report(table(spark, sf_dir, "region").select(F.col("r_name").alias("name"), F.col("r_regionkey").alias("key")), "regions")


@query("SNK11", "select p_partkey, p_name from part where p_size > 40 and p_brand like 'Brand#1%'")
def subset_export(spark, sf_dir):
    path = shared_path(spark, "subset")
    writers.write_json(writers.subset(table(spark, sf_dir, "part"), (F.col("p_size") > 40) & F.col("p_brand").startswith("Brand#1"), ["p_partkey", "p_name"]), path)
    return spark.read.schema("p_partkey bigint, p_name string").json(path)


@query("SNK12", "select n_regionkey, n_name, n_nationkey from nation")
def grouped_export(spark, sf_dir):
    grouped = writers.grouped_json(table(spark, sf_dir, "nation"), "n_regionkey", ["n_name", "n_nationkey"])
    return grouped.select("n_regionkey", F.explode(F.from_json("entries", "array<struct<n_name:string,n_nationkey:bigint>>")).alias("e")).select("n_regionkey", "e.*")


@query(
    "SNK13",
    """with s as (select l_linenumber as layer, avg(l_discount) as score from lineitem group by 1), b as (select layer from s order by score desc, layer limit 1)
select l_returnflag as truth, count(*) filter (where l_linestatus = 'F') as F, count(*) filter (where l_linestatus = 'O') as O from lineitem where l_linenumber = (select layer from b) group by 1""",
)
def confusion_matrix(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("layer"), "l_discount", F.col("l_returnflag").alias("truth"), F.col("l_linestatus").alias("guess"))
    scored = rows.join(F.broadcast(rows.groupBy("layer").agg(F.avg("l_discount").alias("score"))), "layer")  # seven layers
    return writers.confusion_of_best(scored, "layer", "score", "truth", "guess", ["F", "O"])


@query("ARR11", "select l_returnflag, " + ", ".join(f"round(avg(l_quantity) filter (where l_linenumber = {n}), 4) as L{n:02d}_m" for n in range(1, 8)) + " from lineitem group by 1")
def wide_layers(spark, sf_dir):
    long = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linenumber").agg(F.round(F.avg("l_quantity"), 4).alias("m"))
    return writers.wide(long, ["l_returnflag"], "l_linenumber", list(range(1, 8)), ["m"])


# ---------------------------------------------------------------- resumable state


@query("STM1 STM3 JN10", "select c_custkey, round(c_acctbal * 2, 2) as doubled, 2 as runs from customer")
def resumed(spark, sf_dir):
    """Half is done, then all is asked for; each key is worked on once."""
    path, todo = shared_path(spark, "resumed"), table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    work = lambda df: df.select("c_custkey", F.round(F.col("c_acctbal") * 2, 2).alias("doubled"))
    resume.resume(spark, todo.where("c_custkey % 2 = 0"), path, ["c_custkey"], work)
    resume.resume(spark, todo, path, ["c_custkey"], work)
    return resume.finished(spark, path, "c_custkey bigint, doubled double").withColumn("runs", F.lit(len(resume.committed(spark, path))))


@query("STM2", "select 'good' as side, count(*) as n from nation where n_nationkey % 5 <> 0 union all select 'bad', count(*) from nation where n_nationkey % 5 = 0")
def quarantined(spark, sf_dir):
    path = shared_path(spark, "damaged")
    line = F.when(F.col("n_nationkey") % 5 == 0, F.lit('{"k": broken')).otherwise(F.to_json(F.struct(F.col("n_nationkey").alias("k"))))
    table(spark, sf_dir, "nation").select(line.alias("value")).write.text(path)
    rows = spark.read.schema("k bigint, _corrupt_record string").json(path).persist()
    good, bad = resume.quarantine(rows)
    return good.agg(F.lit("good").alias("side"), F.count("*").alias("n")).union(bad.agg(F.lit("bad"), F.count("*")))


@query("STM4", "select 'final' as asked, count(*) as rows, 2 as chunks from supplier union all select 'final,span', count(*) filter (where s_suppkey % 2 = 0), 2 from supplier union all select 'window', null, 2")
def chunk_cache(spark, sf_dir):
    cache, rows = resume.ChunkCache(spark, shared_path(spark, "chunks")), table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    cache.add(rows.where("s_suppkey % 2 = 0"), ["final", "span"])
    cache.add(rows.where("s_suppkey % 2 = 1"), ["final"])
    out = [(",".join(w), None if (got := cache.get(w)) is None else got.count(), cache.index().count()) for w in (["final"], ["final", "span"], ["window"])]
    return spark.createDataFrame(out, "asked string, rows bigint, chunks int")


@query("STM5", "select p_partkey, case when p_partkey <= 100 then 'first' else 'second' end as v from part")
def appended_once(spark, sf_dir):
    path, parts = shared_path(spark, "once"), table(spark, sf_dir, "part").select("p_partkey")
    resume.append_once(spark, parts.where("p_partkey <= 100").withColumn("v", F.lit("first")), path, ["p_partkey"])
    resume.append_once(spark, parts.union(parts).withColumn("v", F.lit("second")), path, ["p_partkey"])
    return resume.finished(spark, path, "p_partkey bigint, v string")


@query("STM6 SNK8", "select count(*) as rows, min(c_custkey) as first, max(c_custkey) as last, true as bounded, count(*) as back from customer")
def shard_manifest(spark, sf_dir):
    root = shared_path(spark, "shards")
    manifest = resume.write_shards(table(spark, sf_dir, "customer").select("c_custkey"), root, 50, "c_custkey")
    back = resume.read_shards(spark, root).agg(F.count("*").alias("back"))  # one row
    return manifest.agg(F.sum("n").alias("rows"), F.min("first").alias("first"), F.max("last").alias("last"), (F.max("n") <= 50).alias("bounded")).crossJoin(back)


@query("STM1 STM3", "select c_custkey, round(c_acctbal * 2, 2) as doubled, case when c_custkey % 3 = 0 then 0 else 1 end as run from customer")
def streamed_once(spark, sf_dir):
    """Three arrivals of files that share keys; the query stops in its second batch, and goes on in another run."""
    from pyspark.errors import StreamingQueryException

    from pairloom.streaming import keyed

    root, rows = shared_path(spark, "stream"), table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    runs, batches = [], []

    def work(batch):
        batches.append(len(runs))
        if len(batches) == 2:
            raise InterruptedError("stopped on the way")
        return batch.select("c_custkey", F.round(F.col("c_acctbal") * 2, 2).alias("doubled"), F.lit(len(runs)).alias("run"))

    for n in range(3):  # each arrival has its third of the keys and those of the ones before
        rows.where(f"c_custkey % 3 <= {n}").write.mode("append").parquet(f"{root}/in")
        try:
            keyed.stream_once(spark, f"{root}/in", "c_custkey bigint, c_acctbal double", f"{root}/out", f"{root}/state", work, ["c_custkey"]).awaitTermination()
        except StreamingQueryException as error:
            if "stopped on the way" not in str(error):
                raise
            runs.append("stopped")
    return spark.read.parquet(f"{root}/out").drop("batch")


@query("STM1 AGG12", "select date_trunc('day', ts) as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def streamed_windows(spark, sf_dir):
    """Counts by day of a stream of events, whole after its last batch."""
    root = shared_path(spark, "windows")
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("pathGlobFilter", "events.parquet").option("recursiveFileLookup", "true").parquet(sf_dir)
    counts = resume.windowed_counts(stream.withColumn("ts", F.col("ts").cast("timestamp")))

    def write(batch, number):
        batch.write.mode("overwrite").parquet(f"{root}/out")  # of complete batches the last one stays

    counts.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{root}/out").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("STM2", "select c_custkey, round(c_acctbal + 1, 2) as more, 1 as damaged, cast((select count(*) from customer where c_custkey % 4 = k) as bigint) as again from customer, (select 0 as k) z")
def damaged_batch(spark, sf_dir):
    """Four batches by key; a byte of one flips: it is set aside, and its keys alone are done again."""
    from pairloom.streaming import verified

    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    work = lambda df: df.select("c_custkey", F.round(F.col("c_acctbal") + 1, 2).alias("more"))
    log = verified.VerifiedLog(spark, shared_path(spark, "verified"), "c_custkey bigint, more double", ["c_custkey"])
    log.resume(rows.where("c_custkey % 4 = 0"), work)
    first = sorted(resume.committed(spark, log.path))[0]
    for n in range(1, 4):
        log.resume(rows.where(f"c_custkey % 4 = {n}"), work)
    verified.flip_byte(spark, f"{log.path}/batch={first}")
    said = log.resume(rows, work)
    return log.read().withColumns({"damaged": F.lit(said["damaged"]), "again": F.lit(said["done"]).cast("bigint")})


# ---------------------------------------------------------------- calls and models


@query("EXT1 EXT2 EXT3 STR14", "select n_nationkey, case when n_nationkey % 6 <> 0 then length(n_name) end as said from nation")
def asked(spark, sf_dir):
    """Calls that answer with a fenced JSON object, and sometimes with nothing of use."""

    def service(prompt: str) -> str:
        name, key = prompt.rsplit(" ", 1)
        return "not json" if int(key) % 6 == 0 else '```json\n{"n": %d}\n```' % len(name)

    rows = table(spark, sf_dir, "nation").select("n_nationkey", F.concat_ws(" ", "n_name", F.col("n_nationkey").cast("string")).alias("prompt"))
    return external.ask(rows, "n_nationkey", "prompt", service, retries=2, pause=0.0).select("n_nationkey", F.get_json_object("response", "$.n").cast("int").alias("said"))


@query("EXT1 EXT2 STM3", "select c_custkey, case when c_custkey % 6 <> 0 then length(c_name) else 0 end as said, 2 as runs from customer")
def asked_in_windows(spark, sf_dir):
    """Windows of calls over all customers; what failed in the first run is asked again in the second."""
    from pairloom.streaming import calls

    def service(prompt: str) -> str:
        name, key = prompt.rsplit(" ", 1)
        return "not json" if int(key) % 6 == 0 else '```json\n{"n": %d}\n```' % len(name)

    path = shared_path(spark, "answers")
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("key"), F.concat_ws(" ", "c_name", F.col("c_custkey").cast("string")).alias("prompt"))
    calls.ask_into(rows, "key", "prompt", path, service, retries=2, pause=0.0, flush=500)
    out = calls.ask_into(rows, "key", "prompt", path, lambda p: '{"n": 0}', flush=500)
    runs = len(writers.list_names(spark, path))
    return out.select(F.col("key").cast("bigint").alias("c_custkey"), F.get_json_object("response", "$.n").cast("int").alias("said"), F.lit(runs).alias("runs"))


WORDS = "with w as (select n_nationkey as k, string_split(n_name || ' of the world', ' ') as w from nation), l as (select k, len(w) as n, list_transform(w, lambda x: cast(length(x) as double)) as s from w)"


@query(
    "EXT4 EXT5 EXT12",
    f"""{WORDS}, s as (select k, n, s[-1] as s0, s[-1] + s[-2] as s1, s[-1] + 2 * s[-2] + s[-3] as s2 from l)
select k as n_nationkey, layer, cast(n - 1 as integer) as token, case layer when 0 then s0 when 1 then s1 else s2 end as first, s2 * 4 as logit_d from s, (values (0), (1), (2)) as y(layer)""",
)
def model_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").select("n_nationkey", F.concat("n_name", F.lit(" of the world")).alias("prompt"))
    made = models.activations(rows, "n_nationkey", "prompt", models.LengthModel)
    return made.select("n_nationkey", "layer", "token", F.get("vec", F.lit(0)).alias("first"), F.get("logits", F.lit(3)).alias("logit_d"))


@query("EXT6", f"{WORDS} select k as n_nationkey, 'ablated' as run, 0.0 as logit_a from l union all select k, 'patched', 7.0 from l")
def hooked_rows(spark, sf_dir):
    """A head's part set to zero in the last layer; the last token's state taken from another prompt."""
    rows = table(spark, sf_dir, "nation").select("n_nationkey", F.concat("n_name", F.lit(" of the world")).alias("prompt"))
    source = models.LengthModel().forward("one two")[1] * 0 + 7.0
    out = None
    for name, hook in (("ablated", models.ablated({2}, slice(0, 1))), ("patched", models.patched(source, {2}))):
        made = models.activations(rows, "n_nationkey", "prompt", models.LengthModel, hook).where("layer = 2")
        part = made.select("n_nationkey", F.lit(name).alias("run"), F.get("logits", F.lit(0)).alias("logit_a"))
        out = part if out is None else out.union(part)
    return out


# ---------------------------------------------------------------- validation

RECORD = {
    "type": "object", "required": ["id", "lines", "parts"], "additionalProperties": False,
    "properties": {
        "id": {"type": "string", "pattern": "^o_[0-9]+$"}, "status": {"type": ["string", "null"], "enum": ["F", "O", None]},
        "lines": {"type": "array", "maxItems": 6, "items": {"$ref": "#/$defs/Line"}}, "parts": {"type": "object", "additionalProperties": {"type": "number", "maximum": 48}},
    },
    "$defs": {"Line": {"type": "object", "required": ["flag"], "properties": {"flag": {"type": "string", "enum": ["A", "N"]}, "quantity": {"type": "integer", "minimum": 2}}}},
}
MESSY = "with l as (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_quantity, l_extendedprice, l_returnflag) - 1 as i from lineitem), o as (select l_orderkey as k, count(*) as n from l group by 1)"


@query(
    "DQ1 SRC13",
    f"""{MESSY} select o_orderkey, path, message from (
select o_orderkey, 'status' as path, 'is none of "F", "O", null' as message from orders join o on k = o_orderkey where o_orderstatus = 'P'
union all select o_orderkey, '', 'must not have extra' from orders join o on k = o_orderkey where o_orderkey % 5 = 0
union all select o_orderkey, 'id', 'does not match ^o_[0-9]+$' from orders join o on k = o_orderkey where o_orderkey % 7 = 0
union all select k, 'lines', 'has more items than 6' from o where n > 6
union all select l_orderkey, 'lines/' || i || '/flag', 'is none of "A", "N"' from l where l_returnflag = 'R' and l_linenumber <> 4
union all select l_orderkey, 'lines/' || i, 'lacks flag' from l where l_linenumber = 4
union all select l_orderkey, 'lines/' || i || '/quantity', 'is less than 2.0' from l where l_quantity < 2
union all select l_orderkey, 'parts/p' || i, case when l_linenumber = 2 then 'is not of type number' else 'is more than 48.0' end from l where l_linenumber = 2 or l_quantity > 48)""",
)
def schema_violations(spark, sf_dir):
    """Orders as nested records: types, enumerations, items, values of a map, members that should not be there."""
    from pairloom.operators.json_schema import violations

    number = F.col("l_linenumber")
    flag = F.when(number != 4, F.col("l_returnflag"))
    part = F.when(number == 2, F.lit('"many"')).otherwise(F.col("l_quantity").cast("string"))
    line = F.struct(number.alias("n"), "l_quantity", "l_extendedprice", "l_returnflag", F.to_json(F.struct(flag.alias("flag"), F.col("l_quantity").cast("int").alias("quantity"))).alias("j"), part.alias("part"))
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(line)).alias("ls"))  # an order's lines
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus").join(lines, "o_orderkey")
    text = F.concat(
        F.lit('{"id":"'), F.when(F.col("o_orderkey") % 7 == 0, "x").otherwise("o_"), F.col("o_orderkey").cast("string"), F.lit('","status":"'), F.col("o_orderstatus"), F.lit('"'), F.when(F.col("o_orderkey") % 5 == 0, ',"extra":1').otherwise(""),
        F.lit(',"lines":['), F.array_join(F.transform("ls", lambda x: x["j"]), ","), F.lit('],"parts":{'), F.array_join(F.transform("ls", lambda x, i: F.concat(F.lit('"p'), i.cast("string"), F.lit('":'), x["part"])), ","), F.lit("}}"),
    )
    return violations(orders.select("o_orderkey", text.alias("doc")), "doc", RECORD, ["o_orderkey"])


@query("DQ4", "select field, count(*) as n from (select unnest([case when p_partkey % 3 = 0 then 'clinical_coherence' end, case when p_partkey % 5 = 0 then 'annotation_confidence' end, case when p_partkey % 7 = 0 then 'rationale' end, case when p_partkey % 11 = 0 then 'reason_if_null' end, case when p_partkey % 13 = 0 then 'semantic_class' end]) as field from part) where field is not null group by 1")
def strict_violations(spark, sf_dir):
    from pairloom.operators import registry as R

    own = next(i for i in R.INTERVENTIONS if i[0] == "sex")
    k = F.col("p_partkey")
    wrong = lambda n, bad, good: F.when(k % n == 0, bad).otherwise(good)
    columns = {f: F.lit(v[0]) for f, v in R.ENUMS_STRICT.items()} | {"intervention_type": F.lit("sex"), "intervention_family": F.lit(own[1]), "analysis_bucket": F.lit(own[3])}
    if not own[4]:
        columns["edit_strength"] = F.lit("single")
    columns |= {
        "semantic_class": wrong(13, F.lit(next(i[2] for i in R.INTERVENTIONS if i[2] != own[2])), F.lit(own[2])),
        "clinical_coherence": wrong(3, F.lit(None).cast("string"), columns["clinical_coherence"]), "annotation_confidence": wrong(5, F.lit(1.5), F.lit(0.5)),
        "rationale": wrong(7, F.lit(""), F.lit("said")), "text": wrong(11, F.lit(None).cast("string"), F.lit("t")), "reason_if_null": F.lit(""),
    }
    rows = table(spark, sf_dir, "part").select("p_partkey", *[c.alias(n) for n, c in columns.items()])
    return Q.strict_issues(rows, ["p_partkey"], R.intervention_registry(spark)).groupBy("field").agg(F.count("*").alias("n"))


@query("DQ9", "select * from (values ('same keys in another order', true), ('another value', false), ('nothing stored', true)) as t(run, reused)")
def fingerprints(spark, sf_dir):
    path = f"{shared_path(spark, 'fingerprint')}/fingerprint"
    empty = writers.read_text(spark, path)
    writers.write_text(spark, path, Q.fingerprint({"layers": [1, 2], "seed": 42}))
    out = []
    for name, found, config in (("same keys in another order", writers.read_text(spark, path), {"seed": 42, "layers": [1, 2]}), ("another value", writers.read_text(spark, path), {"seed": 43, "layers": [1, 2]}), ("nothing stored", empty, {})):
        try:
            Q.check_fingerprint(found, config)
            out.append((name, True))
        except ValueError:
            out.append((name, False))
    return spark.createDataFrame(out, "run string, reused boolean")


@query(
    "DQ10",
    """select * from (select 'shape' as name, count(*) as n, count(*) filter (where len(embedding) = 64) as passed from embeddings union all select 'identity', count(*), count(*) from embeddings
union all select 'round_trip', count(*), count(*) from embeddings union all select 'negative', count(*), 0 from embeddings)""",
)
def self_checks(spark, sf_dir):
    """Vectors have the model's width; adding no part of a direction changes nothing; what is added and
    removed again is gone; and a shift must not pass for none."""
    from pairloom.functions import vectors as V

    rows = table(spark, sf_dir, "embeddings").select(F.col("embedding").cast("array<double>").alias("v"))
    axis = F.array(*[F.lit(1.0 if i == 0 else 0.0) for i in range(64)])
    near = lambda a, b: F.forall(F.zip_with(a, b, lambda x, y: F.abs(x - y) < 1e-9), lambda x: x)
    removed = V.remove_direction(F.col("v"), axis)
    return Q.self_checks(rows, {
        "shape": F.size("v") == 64, "identity": near(V.add_direction(F.col("v"), axis, 0.0), F.col("v")),
        "round_trip": near(V.remove_direction(V.add_direction(F.col("v"), axis, 2.5), axis), removed),
        "negative": near(V.add_direction(F.col("v"), axis, 1.0), F.col("v")),
    })


@query("DQ11", "select count(*) filter (where value > 50) as large, count(*) filter (where event_type = 'click') as clicks, count(*) as rows from events")
def observed_counters(spark, sf_dir):
    from pairloom.plans.experiments import observed

    path = shared_path(spark, "observed")
    df, watch = observed(table(spark, sf_dir, "events"), "events", {"large": F.col("value") > 50, "clicks": F.col("event_type") == "click"})
    df.write.parquet(path)
    return spark.createDataFrame([(watch.get["large"], watch.get["clicks"])], "large bigint, clicks bigint").crossJoin(spark.read.parquet(path).agg(F.count("*").alias("rows")))  # one row each


@query("DQ13", "select * from (values ('read', true, 5, 'o_orderkey,o_totalprice', null), ('double', true, 5, 'twice', null)) as t(step, ok, rows, columns, error)")
def dry_runs(spark, sf_dir):
    made = Q.dry_run(table(spark, sf_dir, "orders"), {"read": lambda df: df.select("o_orderkey", "o_totalprice"), "double": lambda df: df.select((F.col("o_totalprice") * 2).alias("twice"))})
    return made.withColumn("rows", F.col("rows").cast("int"))


@query("SMP10", "select p_partkey from part where p_partkey % 2 = 0 and p_partkey between 1 and 40")
def until_target(spark, sf_dir):
    """Batches of ten until 18 even keys are there."""
    part = table(spark, sf_dir, "part").select("p_partkey")
    used = sampling.until_target((part.where(f"p_partkey > {low} and p_partkey <= {low + 10}") for low in range(0, 1000, 10)), F.col("p_partkey") % 2 == 0, 18)
    out = used[0]
    for batch in used[1:]:
        out = out.union(batch)
    return out
