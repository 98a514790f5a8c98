"""What the operators refuse, and why: outcome tables of the rules on files, columns and catalogues."""

from __future__ import annotations

from pyspark.sql import functions as F

from beaconry.operators import drift as D
from beaconry.operators import scorecard as C
from beaconry.plans.registry import query
from beaconry.session import work_path
from beaconry.sources import bindings as B
from beaconry.sources import readers


@query("src_validate", """
    WITH m AS (SELECT strftime(l_shipdate, '%Y-%m') AS dataset, (year(l_shipdate) * 12 + month(l_shipdate)) % 4 AS k, COUNT(*) AS n
               FROM lineitem GROUP BY 1, 2)
    SELECT dataset, CASE WHEN k IN (0, 1) THEN n ELSE 0 END AS n_rows,
           CASE k WHEN 1 THEN 'no label' WHEN 2 THEN 'no rows' WHEN 3 THEN 'missing' END AS reason FROM m""")
def _validate(t):
    """Monthly exports of the order lines: whole, without the label, with a header only, or never delivered."""
    path = work_path(t.spark, "exports")
    at = F.col("l_shipdate")
    lines = t.lineitem.select(
        F.date_format(at, "yyyy-MM").alias("dataset"), ((F.year(at) * 12 + F.month(at)) % 4).alias("kind"),
        "l_orderkey", "l_quantity", "l_returnflag")
    months = lines.select("dataset", "kind").distinct()

    def export(rows):
        rows.write.mode("append").option("header", True).partitionBy("dataset").csv(path)

    export(lines.where("kind = 0").drop("kind"))
    export(lines.where("kind = 1").drop("kind", "l_returnflag"))
    months.where("kind = 2").select("dataset", F.lit("l_orderkey,l_quantity,l_returnflag").alias("value")).write.mode(
        "append").partitionBy("dataset").text(path)
    return readers.check_files(t.spark, path, months, "l_returnflag", r"dataset=([^/]+)/").drop("n_files")


@query("src_catalogue", """
    SELECT p_brand AS plan_name, CASE p_size % 3 WHEN 0 THEN 'employee_only' WHEN 1 THEN 'couple' ELSE 'family' END AS coverage_tier,
           MAX(p_retailprice) AS employer_premium, MIN(p_retailprice) AS employee_premium, COUNT(*)::DOUBLE AS deductible,
           p_brand IN (SELECT p_brand FROM part GROUP BY 1 HAVING COUNT(*) % 2 = 0) AS hsa_eligible
    FROM part GROUP BY ALL""")
def _catalogue(t):
    """A catalogue file with one plan a brand is written and read. Its size is that of the brands, whatever the number of parts."""
    path = work_path(t.spark, "catalogue")
    tier = F.when(F.col("p_size") % 3 == 0, "employee_only").when(F.col("p_size") % 3 == 1, "couple").otherwise("family")
    tiers = t.part.groupBy("p_brand", tier.alias("tier")).agg(
        F.max("p_retailprice").alias("employer_monthly_premium"), F.min("p_retailprice").alias("employee_monthly_premium"),
        F.count("*").alias("deductible"))
    amounts = F.struct("employer_monthly_premium", "employee_monthly_premium", "deductible")
    plans = tiers.groupBy("p_brand").agg(F.struct(
        (F.sum("deductible") % 2 == 0).alias("hsa_eligible"),
        F.map_from_entries(F.collect_list(F.struct("tier", amounts))).alias("tiers")).alias("plan"))
    whole = plans.agg(F.map_from_entries(F.collect_list(F.struct("p_brand", "plan"))).alias("health_plans"))
    whole.select(F.to_json(F.struct("health_plans")).alias("value")).write.text(path)
    return readers.read_catalogue(t.spark, path).select(
        "plan_name", "coverage_tier", "employer_premium", "employee_premium", "deductible", "hsa_eligible")


@query("common_numeric_cols", """
    WITH c AS (SELECT l_shipdate >= TIMESTAMP '1997-01-01' AS late, COUNT(*) AS n FROM lineitem GROUP BY 1)
    SELECT unnest(['l_orderkey', 'l_quantity', 'l_tax']) AS feature, (SELECT n FROM c WHERE NOT late) AS baseline_n,
           (SELECT n FROM c WHERE late) AS current_n""")
def _common(t):
    """Later order lines lack a column, hold another as text, and carry the label."""
    late = F.col("l_shipdate") >= F.lit("1997-01-01 00:00:00").cast("timestamp_ntz")
    columns = ["l_orderkey", "l_quantity", "l_extendedprice", "l_tax", "l_discount"]
    now = t.lineitem.where(late).select(
        "l_orderkey", "l_quantity", F.col("l_extendedprice").cast("string").alias("l_extendedprice"), "l_tax", "l_discount")
    return D.shared_features(t.lineitem.where(~late).select(*columns, "l_suppkey"), now, "l_discount")


@query("pred_fallback", """
    WITH p AS (SELECT lang, COUNT(*) AS n, round(AVG((actual = prediction)::INT), 4) AS acc FROM predictions JOIN documents USING (doc_id) GROUP BY lang)
    SELECT 'whole' AS batch, lang, NULL AS reason, n, acc AS accuracy FROM p
    UNION ALL SELECT 'without predictions', lang, 'missing columns: prediction', n, NULL FROM p""")
def _fallback(t):
    """A batch without predictions gets a reason and no score; labels never stand in for predictions."""
    whole = B.predictions(t).join(t.documents.select("doc_id", "lang"), "doc_id")

    def outcome(name, batch):
        why = C.refusal(batch, "actual", "prediction")
        sizes = batch.groupBy("lang").agg(F.count("*").alias("n"))
        if why is None:
            scores = C.scorecard(batch, "lang").select(F.col("lang").alias("_lang"), F.round("accuracy", 4).alias("accuracy"))
            sizes = sizes.join(scores, F.col("lang").eqNullSafe(F.col("_lang"))).drop("_lang")
        else:
            sizes = sizes.withColumn("accuracy", F.lit(None).cast("double"))
        return sizes.select(F.lit(name).alias("batch"), "lang", F.lit(why).cast("string").alias("reason"), "n", "accuracy")

    return outcome("whole", whole).unionByName(outcome("without predictions", whole.drop("prediction")))
