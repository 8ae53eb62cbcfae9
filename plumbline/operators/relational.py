"""The relational operators of the loaders and samplers: joins, filters, sets, samples, over the tables of the driver."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from plumbline.operators.behavior import active_days, r6
from plumbline.operators.evaluate import md5_of
from plumbline.operators.facts import facts, sql
from plumbline.operators.prefix import cumulative
from plumbline.operators.trailing import day_of
from plumbline.scratch import cut, numbered
from plumbline.sources.readers import labelled_csv, path_labels, tri_state
from plumbline.sources.tables import table


def meta_with_text(spark: SparkSession, d: str) -> DataFrame:
    """Equi-join of metadata and texts on reviewer, business and day: N:M where either side repeats the three."""
    m = table(spark, d, "yelp_nyc_metadata", "reviewer_id", "business_id", "date", "rating", "label").withColumn("day", day_of("date")).drop("date")
    t = table(spark, d, "yelp", "reviewer_id", "business_id", "date", "text").withColumn("day", day_of("date")).drop("date")
    j = m.join(t, ["reviewer_id", "business_id", "day"])
    return j.select("reviewer_id", "business_id", "day", "rating", (F.col("label") == -1).alias("is_fake"), F.length("text").alias("chars"), F.lit("nyc").alias("source_dataset"))


def path_scan(spark: SparkSession, d: str) -> DataFrame:
    """The rule of the text archive on paths made of the columns of `reviews`."""
    r = table(spark, d, "reviews", "id", "is_fake", "polarity", "fold", "hotel")
    kind = F.when(F.col("is_fake"), "deceptive_x").when(~F.col("is_fake"), "truthful_x").otherwise("other")
    path = F.concat_ws("/", F.lit("op"), F.concat(F.coalesce("polarity", F.lit("no")), F.lit("_polarity")), kind, F.coalesce(F.lower(F.trim("fold")), F.lit("none")), F.concat(F.lit("d_"), F.coalesce("hotel", F.lit("9")), F.lit("_"), "id", F.lit(".txt")))
    return path_labels(r.select("id", path.alias("path")), "path").drop("path").distinct()


def labelled(spark: SparkSession, d: str) -> DataFrame:
    """The mapping of the generated-reviews CSV on `reviews`."""
    r = table(spark, d, "reviews", "category", "rating", "is_fake", "text").select("category", "rating", F.when(F.col("is_fake"), "CG").otherwise("OR").alias("label"), F.col("text").alias("text_"))
    return labelled_csv(r, "x").groupBy("is_fake", "generator", "category").agg(F.count(F.lit(1)).alias("n"), F.count("text").alias("n_text"))


def tri_labels(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "yelp_nyc_metadata", "review_id", "label", "loaded_at")
    # -1 is a filtered review, 1 a recommended one: 1 and 0 in the notation of the campaign file.
    flag = F.when(F.col("label") == -1, 1.0).when(F.col("label") == 1, 0.0).otherwise(F.col("label"))
    return m.select(tri_state(flag).alias("is_fake")).groupBy("is_fake").agg(F.count(F.lit(1)).alias("n"))


def seed_sample(spark: SparkSession, d: str, n: int = 20) -> DataFrame:
    """n records per source in the order of MD5 of id and seed: a sampling operator, so its limit is its purpose."""
    r = table(spark, d, "reviews", "id", "source_dataset").distinct().withColumn("h", F.md5(F.concat_ws("|", "id", F.lit("42")))).withColumn("one", F.lit(1))
    return cumulative(r, ["source_dataset"], [F.col("h"), F.col("id")], {"place": "one"}).filter(F.col("place") <= n).select("source_dataset", "id", "place")


def seed_texts(spark: SparkSession, d: str) -> DataFrame:
    """Genuine records of 80 to 400 characters: the seeds of generated ones."""
    return table(spark, d, "reviews", "id", "text", "is_fake").filter((F.length("text").between(80, 400)) & ~F.col("is_fake")).select("id").distinct()


def singletons(spark: SparkSession, d: str) -> DataFrame:
    """Reviews by reviewers of a single review, as a semi-join with their set."""
    r = facts(spark, d)
    one = r.groupBy("u").agg(F.count(F.lit(1)).alias("n")).filter("n = 1").select("u")
    return r.join(one, "u", "left_semi").select("review_id")


def campaign_rows(spark: SparkSession, d: str) -> DataFrame:
    r = facts(spark, d)
    return r.join(r.filter("y = 1").select("b").distinct(), "b", "left_semi").select("review_id", "b")


def pending(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose text isn't among the texts already in `reviews`."""
    done = table(spark, d, "reviews", "text").filter("text is not null").distinct()
    return table(spark, d, "documents", "doc_id", "text").filter("text is not null").join(done, "text", "left_anti").select("doc_id")


def task_grid(spark: SparkSession, d: str) -> DataFrame:
    """Category x rating x split x generator tasks not yet done: a cross product of short lists, less the keys that exist."""
    key = ["category", "rating", "split_role", "generator"]
    clean = lambda c: F.lower(F.trim(c))
    roles = F.broadcast(table(spark, d, "fold_roles", "fold", "split_role").select(clean("fold").alias("f"), "split_role"))  # a row per fold
    r = table(spark, d, "reviews", "category", "rating", "fold", "generator").select("category", "rating", clean("fold").alias("f"), clean("generator").alias("generator"))
    done = r.join(roles, "f").select(*key).distinct()
    plan = roles.select("split_role").distinct().crossJoin(spark.createDataFrame([(float(v),) for v in range(1, 6)], "rating double"))
    names = lambda c: r.select(c).filter(F.col(c).isNotNull()).distinct()
    # Categories, generators, ratings and splits are few by nature; the grid is their product.
    grid = names("category").crossJoin(F.broadcast(names("generator"))).crossJoin(F.broadcast(plan))
    return grid.join(done, key, "left_anti").select(*key)


def shuffled_tasks(spark: SparkSession, d: str, seed: int = 42) -> DataFrame:
    """The open tasks in a seeded order: place 1.. by the MD5 of task and seed."""
    t = task_grid(spark, d)
    key = F.concat_ws("|", "category", F.col("rating").cast("int").cast("string"), "split_role", "generator", F.lit(str(seed)))
    return numbered(t.withColumn("h", F.md5(key)), ["h"], "place").drop("h")


def sample(spark: SparkSession, d: str, n: int = 300) -> DataFrame:
    """n documents (or all, if there are fewer) by MD5 of id and seed: a sampling operator, so its limit is its purpose."""
    h = F.md5(F.concat_ws("|", "doc_id", F.lit("42")))
    return table(spark, d, "documents", "doc_id").orderBy(h, "doc_id").limit(n)


def source_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "reviews", "source_dataset", "is_fake").groupBy("source_dataset", "is_fake").agg(F.count(F.lit(1)).alias("n"))


def distinct_counts(spark: SparkSession, d: str) -> DataFrame:
    return facts(spark, d).agg(F.count_distinct("u").alias("accounts"), F.count_distinct("b").alias("businesses"), F.count(F.lit(1)).alias("reviews"))


def value_counts(spark: SparkSession, d: str) -> DataFrame:
    c = facts(spark, d).groupBy("rating").agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("share", r6(F.col("n") / F.sum("n").over(Window.partitionBy())))  # one row per rating


def json_props(spark: SparkSession, d: str) -> DataFrame:
    """Sum of a JSON member per event type."""
    e = table(spark, d, "events", "event_type", "props").withColumn("k", F.get_json_object("props", "$.k").cast("bigint"))
    return e.groupBy("event_type").agg(F.sum("k").alias("k"), F.count("k").alias("n"))


def lag_days(spark: SparkSession, d: str) -> DataFrame:
    """Days since the reviewer's review before: a day's first review has the gap to the day before, the others 0."""
    r = cut(facts(spark, d).select("review_id", "u", "day"))
    first = r.groupBy("u", "day").agg(F.min("review_id").alias("_first"))
    r = r.join(active_days(r).join(first, ["u", "day"]), ["u", "day"])
    return r.select("review_id", F.when(F.col("review_id") == F.col("_first"), F.col("gap")).otherwise(0).alias("gap"))


def reviewer_business(spark: SparkSession, d: str) -> DataFrame:
    """Reviews with the counts of their reviewer and business, by joins of aggregates (the engine picks broadcast or sort)."""
    r = facts(spark, d)
    u, b = r.groupBy("u").agg(F.count(F.lit(1)).alias("u_n")), r.groupBy("b").agg(F.count(F.lit(1)).alias("b_n"))
    return r.select("review_id", "u", "b").join(u, "u", "left").join(b, "b", "left").select("review_id", "u_n", "b_n")


def orders_shape(spark: SparkSession, d: str) -> DataFrame:
    """Line items joined with their orders, per customer segment of status: a plain star join with pushed filters."""
    li = table(spark, d, "lineitem", "l_orderkey", "l_quantity", "l_extendedprice", "l_discount", "l_shipdate").filter("l_shipdate >= timestamp_ntz '1996-01-01 00:00:00'")
    o = table(spark, d, "orders", "o_orderkey", "o_orderpriority")
    j = li.join(o, li["l_orderkey"] == o["o_orderkey"])
    return j.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


QUERIES = {
    "j01_meta_with_text": meta_with_text, "s02_path_labels": path_scan, "s03_labelled_csv": labelled, "s07_tri_state": tri_labels, "t06_stratified_sample": seed_sample, "filter04_length_between": seed_texts, "j05_singletons": singletons,
    "j06_campaign_products": campaign_rows, "j07_pending": pending, "t07_sample": sample, "t08_shuffled_tasks": shuffled_tasks, "j08_j17_task_grid": task_grid, "a24_source_counts": source_counts, "a08_distinct_counts": distinct_counts, "a09_value_counts": value_counts, "f13_json": json_props,
    "w05_lag_days": lag_days, "j02_j03_stats_joins": reviewer_business, "star_join": orders_shape,
}
_DAY = lambda c: rf"coalesce(try_cast(regexp_extract(trim({c}), '^\d{{4}}-\d{{1,2}}-\d{{1,2}}') as date), try_strptime(trim({c}), '%m/%d/%Y')::date, try_strptime(trim({c}), '%b %d, %Y')::date)"
_GRID = """select category, rating, split_role, generator from (select distinct category from reviews where category is not null), (select unnest([1.0, 2.0, 3.0, 4.0, 5.0])::double rating), (select distinct split_role from fold_roles),
 (select distinct lower(trim(generator)) generator from reviews where generator is not null) except select category, rating, split_role, lower(trim(generator)) from reviews join fold_roles on lower(trim(fold_roles.fold)) = lower(trim(reviews.fold))"""
SQL = {
    "j01_meta_with_text": f"select m.reviewer_id, m.business_id, m.day, rating, label = -1 is_fake, length(text) chars, 'nyc' source_dataset from (select *, {_DAY('date')} as day from yelp_nyc_metadata) m join (select *, {_DAY('date')} as day from yelp) t on m.reviewer_id = t.reviewer_id and m.business_id = t.business_id and m.day = t.day",
    "s02_path_labels": r"select distinct id, is_fake, case when polarity in ('positive', 'negative') then polarity end polarity, case when regexp_full_match(lower(trim(fold)), 'fold\d+') then lower(trim(fold)) end fold, case when regexp_full_match(lower(hotel), '[a-z]+') then lower(hotel) end hotel from reviews where is_fake is not null",
    "s03_labelled_csv": "select coalesce(is_fake, false) is_fake, case when is_fake then 'language_model' else 'human' end generator, category, count(*) n, count(text) n_text from reviews group by 1, 2, 3",
    "s07_tri_state": "select case when label = -1 then true when label = 1 then false end is_fake, count(*) n from yelp_nyc_metadata group by 1",
    "t06_stratified_sample": "select source_dataset, id, i place from (select *, row_number() over (partition by source_dataset order by md5(id || '|42'), id) i from (select distinct id, source_dataset from reviews)) where i <= 20",
    "filter04_length_between": "select distinct id from reviews where length(text) between 80 and 400 and not is_fake", "j05_singletons": sql("select review_id from r where u in (select u from r group by 1 having count(*) = 1)"),
    "j06_campaign_products": sql("select review_id, b from r where b in (select b from r where y = 1)"), "j07_pending": "select doc_id from documents d where text is not null and not exists (select 1 from reviews r where r.text = d.text)",
    "j08_j17_task_grid": _GRID, "t07_sample": "select doc_id from documents order by md5(doc_id || '|42'), doc_id limit 300",
    "t08_shuffled_tasks": f"select *, row_number() over (order by md5(category || '|' || rating::int || '|' || split_role || '|' || generator || '|42')) place from ({_GRID})",
    "a24_source_counts": "select source_dataset, is_fake, count(*) n from reviews group by 1, 2", "a08_distinct_counts": sql("select count(distinct u) accounts, count(distinct b) businesses, count(*) reviews from r"),
    "a09_value_counts": sql("select rating, count(*) n, round(count(*) / sum(count(*)) over (), 6) as share from r group by 1"), "f13_json": "select event_type, sum((props::json ->> '$.k')::bigint)::bigint k, count(props::json ->> '$.k') n from events group by 1",
    "w05_lag_days": sql("select review_id, date_diff('day', lag(day) over (partition by u order by day, review_id), day) gap from r"), "j02_j03_stats_joins": sql("select review_id, count(*) over (partition by u) u_n, count(*) over (partition by b) b_n from r"),
    "star_join": "select o_orderpriority, count(*) n, round(sum(l_quantity), 2) quantity, round(sum(l_extendedprice * (1 - l_discount)), 2) revenue from lineitem join orders on l_orderkey = o_orderkey where l_shipdate >= timestamp '1996-01-01' group by 1",
}
