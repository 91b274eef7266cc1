"""Query registry: one callable (spark, sf_dir) -> DataFrame per operator key.

Every query reads the driver's tables through the derived trajectory fixture
(or the ``embeddings`` table directly) and runs over all rows. Floating
results are rounded to 6 digits (and -0.0 folded to 0.0) so that the DuckDB
oracle can compare values across engines.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import ANCHOR_WORDS, ANCHOR_WORDS_ZH, CONTINUOUS_COLS, NORMALIZED_COLS, TASK_SUFFIXES
from ..functions import encodings, geo
from ..functions.arrays import concat_valid, l2_distance, pad_to, valid_mask
from ..functions.temporal import hour
from ..operators import grid, metrics, motion, poi, prompts, search, sequence, split, stats
from ..operators.ordinal import row_ordinal
from ..session import bounded_broadcast
from ..sources.fixture import fixture_tables
from ..sources.io import write_meta
from ..sources.tables import load_pois, load_trips
from .datasets import TripDatasets

_CACHE: dict = {}

# Parameters of the registered queries (the reference's configuration where it has one).
HOP_N = 5            # hopqrytgt-5, hopnegindex-5-5
NEG_M = 5
POI_K = 3            # odpois-3
PRE_LENGTH = 5       # destination cut
ENC_D = 8            # width of the trigonometric encodings


def finish(df: DataFrame) -> DataFrame:
    """Round doubles to 6 digits and turn -0.0 into 0.0; NaN, infinities and
    values of 1e12 and more stay as they are."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            x = F.col(f"`{f.name}`").cast("double")
            # floor(x * 1e6 + 0.5) / 1e6 is bit-identical in every IEEE engine
            # (decimal ties are where engines' round() functions differ).
            rounded = F.floor(x * F.lit(1e6) + F.lit(0.5)) / F.lit(1e6) + F.lit(0.0)
            cols.append(F.when(F.abs(x) < 1e12, rounded).otherwise(x).alias(f.name))
        else:
            cols.append(F.col(f"`{f.name}`"))
    return df.select(*cols)


def datasets(spark: SparkSession, sf_dir: str) -> TripDatasets:
    key = (id(spark), sf_dir)
    if key not in _CACHE:
        from ..session import ship_package
        ship_package(spark)
        fx = fixture_tables(spark, sf_dir)
        ds = TripDatasets(fx["trips"], fx["trip_info"], fx["road_info"], fx["pois"])
        ds.fixture = fx
        _CACHE[key] = ds
    return _CACHE[key]


def grid_datasets(spark: SparkSession, sf_dir: str) -> TripDatasets:
    """The same city with the grid road type."""
    key = (id(spark), sf_dir, "grid")
    if key not in _CACHE:
        ds = datasets(spark, sf_dir)
        _CACHE[key] = TripDatasets(ds.trips, ds.trip_info, ds.road_info, ds.pois, road_type="grid")
    return _CACHE[key]


def _emb(spark, sf_dir) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return e.select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("vec"),
                    F.col("label").cast("long").alias("label"))


def _centroids(spark, sf_dir) -> DataFrame:
    """Label centroids of the embeddings (A13), as arrays ordered by dim."""
    mp = sequence.mean_pool(_emb(spark, sf_dir), "vec", ["label"])
    s = F.array_sort(F.collect_list(F.struct("i", "value")))
    return mp.groupBy("label").agg(s.alias("_s")).select(
        F.col("label").alias("cls"), F.transform("_s", lambda r: r["value"]).alias("cvec"))


def _emb_scores(spark, sf_dir) -> DataFrame:
    """Scores (vec_id, cls, score) = -L2 distance to each label centroid.

    The centroid table has one row per label (10), broadcast by size.
    """
    e = _emb(spark, sf_dir)
    c = bounded_broadcast(_centroids(spark, sf_dir), 10_000)
    return e.crossJoin(c).select(F.col("vec_id").alias("id"), "cls", (-l2_distance("vec", "cvec")).alias("score"))


# ---------------------------------------------------------------------------
def q_load_trips(spark, d):
    """The trip table as a file, through its loader."""
    path = write_meta(datasets(spark, d).trips, "trips-raw")
    p = motion.add_time_features(load_trips(spark, path))
    return finish(p.select("trip", "seq_i", "seconds", "road", "road_prop", "lng", "lat"))


def q_load_pois(spark, d):
    """The place table as a file, through its loader."""
    return finish(load_pois(spark, write_meta(datasets(spark, d).fixture["pois"], "pois-raw")))


def q_point_time_features(spark, d):
    p = datasets(spark, d).points
    return finish(p.select("trip", "seq_i", "seconds", "tod", "weekday", hour("seconds").alias("hour")))


def q_trip_start_context(spark, d):
    p = datasets(spark, d).points
    order = F.struct("time", "seq_i")
    return p.groupBy("trip").agg(F.min_by("weekday", order).alias("start_weekday"),
                                 F.min_by(hour("seconds"), order).alias("start_hour"))


def q_speed_accel_heading(spark, d):
    m = datasets(spark, d).motion_all
    return finish(m.select("trip", "seq_i", "speed", "acceleration", "heading_angle"))


def q_speed_accel_heading_chunked(spark, d):
    """K01 with tiny chunks, so the cross-chunk carry is exercised."""
    ds = datasets(spark, d)
    m = motion.motion_features_all(ds.points, ds.heading, chunk_rows=7)
    return finish(m.select("trip", "seq_i", "speed", "acceleration", "heading_angle"))


def q_describe_points(spark, d):
    return finish(datasets(spark, d).describe_all())


def q_cardinalities(spark, d):
    fx = datasets(spark, d).fixture
    return stats.cardinalities(fx["road_info"], fx["trip_info"])


def q_trip_counts(spark, d):
    fx = datasets(spark, d).fixture
    return stats.trip_counts(fx["trip_info"], fx["trips"])


def q_trip_lengths(spark, d):
    return stats.trip_lengths(datasets(spark, d).trips)


def q_trip_endpoints(spark, d):
    return finish(stats.trip_endpoints(datasets(spark, d).points, ["lng", "lat", "seconds"]))


def q_bounding_box(spark, d):
    return finish(stats.bounding_box(datasets(spark, d).trips))


def q_train_val_test_split(spark, d):
    return datasets(spark, d).split_info.select("trip", "driver", "split")


def q_row_ordinal(spark, d):
    return row_ordinal(datasets(spark, d).fixture["trip_info"], ["trip"], "ordinal").select("trip", "ordinal")


def q_valid_trips(spark, d):
    return datasets(spark, d).valid


def q_trips_in_split(spark, d):
    ds = datasets(spark, d)
    return split.trips_in(ds.trips, ds.split_info).join(ds.split_info.select("trip", "split"), "trip") \
        .select("trip", "seq_i", "split")


def q_known_trips(spark, d):
    return split.known_trips(datasets(spark, d).valid).select("trip", "split")


def q_prefix_sample(spark, d):
    ds = datasets(spark, d)
    # F04 per split: the first int(len * 0.5) trips of each split by row order
    v = ds.valid.select("trip", "split")
    o = row_ordinal(v, ["trip"], group="split", few_groups=True)
    sizes = v.groupBy("split").agg(F.count(F.lit(1)).alias("cnt"))
    return (o.join(F.broadcast(sizes), "split")
            .where(F.col("ordinal") < F.floor(F.col("cnt") * 0.5)).select("trip", "split"))


def q_truncate_trip(spark, d):
    vp = datasets(spark, d).valid_points
    return split.truncate_trip(vp, PRE_LENGTH).select("trip", "pos")


def q_valid_mask(spark, d):
    # each trip's mask over its split's longest trip (the batch length)
    v = datasets(spark, d).valid
    L = v.groupBy("split").agg(F.max("length").cast("int").alias("L"))
    m = v.join(F.broadcast(L), "split").select("trip", valid_mask(F.col("L"), F.col("length")).alias("m"))
    return m.select("trip", F.size(F.filter("m", lambda x: x)).alias("n_true"),
                    F.size(F.filter("m", lambda x: ~x)).alias("n_false"))


def q_batch_assign(spark, d):
    # R07 per split: batches of 16 consecutive trips, a trailing single dropped
    v = datasets(spark, d).valid.select("trip", "split")
    o = row_ordinal(v, ["trip"], group="split", few_groups=True)
    b = o.withColumn("batch_id", F.floor(F.col("ordinal") / 16).cast("long"))
    sizes = b.groupBy("split", "batch_id").agg(F.count(F.lit(1)).alias("bs"))
    return b.join(sizes.where("bs > 1"), ["split", "batch_id"]).select("trip", "split", "batch_id")


def q_trip_features(spark, d):
    return finish(datasets(spark, d).trip_features)


def q_trip_offset(spark, d):
    """P08 over all trips: per-trip span from a grouped aggregate joined back
    (no window over a possibly hot trip; AQE splits a skewed join key)."""
    p = datasets(spark, d).points
    span = p.groupBy("trip").agg(F.min("seconds").alias("s0"), F.max("seconds").alias("s1"))
    j = p.join(span, "trip")
    return finish(j.select("trip", "seq_i", (F.try_divide(F.col("seconds") - F.col("s0"),
                                                          F.col("s1") - F.col("s0")) * 2 - 1).alias("offset")))


def q_fill_missing(spark, d):
    ds = datasets(spark, d)
    return finish(stats.fill_missing(ds.motion_all, ["lng", "speed", "heading_angle"])
                  .select("trip", "seq_i", "lng", "speed", "heading_angle"))


def q_trip_sequences(spark, d):
    seqs = datasets(spark, d).trip_sequences()
    return finish(seqs.select(
        "split", "trip", "length",
        F.aggregate("points", F.lit(0.0), lambda a, p: a + p["lng"]).alias("sum_lng"),
        F.aggregate("points", F.lit(0.0), lambda a, p: a + p["speed"]).alias("sum_speed"),
        F.element_at("points", -1)["road"].alias("last_road")))


def _zstats(ds):
    return stats.zscore_stats(ds.motion_all, NORMALIZED_COLS)


def q_normalize_zscore(spark, d):
    ds = datasets(spark, d)
    vp = ds.valid_points
    z = stats.normalize_zscore(vp, _zstats(ds), NORMALIZED_COLS)
    return finish(z.select("trip", "pos", *NORMALIZED_COLS))


def q_denormalize(spark, d):
    ds = datasets(spark, d)
    tf = ds.trip_features
    back = stats.denormalize(tf, ds.norm_stats, ["lng", "lat"])
    return finish(back.select("trip", "pos", "lng", "lat"))


def q_normalize_minmax(spark, d):
    ds = datasets(spark, d)
    z = stats.normalize_minmax(ds.valid_points, ds.norm_stats, NORMALIZED_COLS)
    return finish(z.select("trip", "pos", *NORMALIZED_COLS))


def q_scale_unit(spark, d):
    vp = datasets(spark, d).valid_points.select("trip", "pos", "speed", "acceleration")
    return finish(stats.scale_unit(vp, ["speed", "acceleration"]))


def q_haversine(spark, d):
    pairs = motion.next_point_rows(datasets(spark, d).trip_rows, ["lng", "lat"])
    return finish(pairs.select("trip", "pos", geo.haversine("lng", "lat", "next_lng", "next_lat").alias("dist_m")))


def q_azimuth(spark, d):
    pairs = motion.next_point_rows(datasets(spark, d).trip_rows, ["lng", "lat"])
    return finish(pairs.select("trip", "pos", geo.azimuth("lat", "lng", "next_lat", "next_lng").alias("bearing")))


def q_grid_project(spark, d):
    p = datasets(spark, d).trips
    return grid.project_to_grid(p, grid.grid_dims(p)).select("trip", "seq_i", F.col("road").cast("double").alias("grid_road"))


def q_grid_cells(spark, d):
    return finish(grid.grid_cells(grid.grid_dims(datasets(spark, d).trips)))


def q_trip_features_grid(spark, d):
    return finish(grid_datasets(spark, d).trip_features.select("trip", "pos", "road", "lng", "lat"))


def q_cardinalities_grid(spark, d):
    return grid_datasets(spark, d).cardinalities()


def q_build_dataset(spark, d):
    """Datasets by type string, written, read back and counted per split; one
    split of each is written again by itself, and the others are still there."""
    import uuid

    from ..sources.io import default_root
    from . import builder
    ds, root = datasets(spark, d), f"{default_root(spark)}/{uuid.uuid4().hex[:8]}"
    out = []
    for i, name in enumerate(("trip", "destination", "tte", "odpois-3", "hopqrytgt-5", "hopqrytgtpois-5-3", "hopnegindex-5-5")):
        builder.dump(ds, name, root)
        builder.dump(ds, name, root, splits=(i % 3,))
        out.append(builder.load(spark, root, name).groupBy("split").agg(F.count(F.lit(1)).alias("n_rows")).withColumn("type", F.lit(name)))
    return reduce(DataFrame.unionByName, out).select("type", "split", "n_rows")


def q_stats_roundtrip(spark, d):
    """All statistics written and read back, the expanded ones preferred; they are checked against the tables."""
    import uuid

    from ..sources.io import default_root
    from . import builder
    root = f"{default_root(spark)}/{uuid.uuid4().hex[:8]}"
    builder.write_stats(datasets(spark, d), root)
    stat, info = builder.load_stats(spark, root, of=datasets(spark, d))
    return finish(stat.crossJoin(F.broadcast(info)))           # one row of cardinalities


def q_stats_merge(spark, d):
    """The expanded statistics of two thirds of the trips (by the id's hash),
    then of all after the other third was merged in, checked against all tables."""
    import uuid

    from ..sources.io import default_root
    from . import builder
    root = f"{default_root(spark)}/{uuid.uuid4().hex[:8]}"
    ds = datasets(spark, d)
    third = F.pmod(F.crc32(F.col("trip").cast("string")), F.lit(3)) == 0
    first, more = (TripDatasets(ds.trips.where(c), ds.trip_info.where(c), ds.road_info, ds.pois) for c in (~third, third))
    builder.write_stats(first, root)
    builder.merge_stats(more, root)
    stat, info = builder.load_stats(spark, root, of=ds)
    hundredths = {q: F.floor(F.col(q) * 100 + 0.5) / 100 for q in ("p25", "p50", "p75")}     # powers differ in their last digits between engines
    return finish(stat.withColumns(hundredths).crossJoin(F.broadcast(info)))                   # one row of cardinalities


def q_model_features(spark, d):
    tf = datasets(spark, d).trip_features
    return finish(tf.select("trip", "pos", "road", "weekday", hour("seconds").alias("hour"), *CONTINUOUS_COLS))


def q_cosine_encoding(spark, d):
    tf = datasets(spark, d).trip_features
    e = tf.select("trip", "pos", F.posexplode(encodings.cosine_encoding("tod", ENC_D)).alias("i", "value"))
    return finish(e)


def q_position_encoding(spark, d):
    v = datasets(spark, d).valid
    L = v.agg(F.max("length").alias("L"))
    pos = L.select(F.explode(F.sequence(F.lit(0), F.col("L") - 1)).alias("pos"))
    e = pos.select("pos", F.posexplode(encodings.position_encoding(F.col("pos").cast("double"), ENC_D)).alias("i", "value"))
    return finish(e)


def q_time_encoding(spark, d):
    tf = datasets(spark, d).trip_features
    e = tf.select("trip", "pos", F.posexplode(encodings.time_encoding(F.col("tod") * 100, ENC_D)).alias("i", "value"))
    return finish(e)


def q_attach_road_coords(spark, d):
    ds = datasets(spark, d)
    j = stats.attach_road_coords(ds.trips, ds.fixture["road_info"])
    return finish(j.select("trip", "seq_i", "road_lng", "road_lat"))


def _origins(ds, split_id=None):
    vp = ds.valid_points.where("pos = 0")
    if split_id is not None:
        vp = vp.where(F.col("split") == split_id)
    return vp.select(F.col("trip").alias("qid"), "lng", "lat")


def q_knn_poi(spark, d):
    ds = datasets(spark, d)
    nb = poi.knn_poi(_origins(ds), ds.fixture["pois"], POI_K)
    return finish(nb.select(F.col("qid").alias("trip"), "rank", "poi_id", F.sqrt("dist2").alias("dist")))


def q_knn_poi_grid(spark, d):
    ds = datasets(spark, d)
    nb = poi.knn_poi(_origins(ds), ds.fixture["pois_large"], POI_K)
    return finish(nb.select(F.col("qid").alias("trip"), "rank", "poi_id", F.sqrt("dist2").alias("dist")))


def q_od_pois(spark, d):
    return datasets(spark, d).od_pois(POI_K)


def q_od_pois_momentum(spark, d):
    return datasets(spark, d).od_pois(POI_K, pre_length=2, momentum=True)


def q_extrapolate_trip(spark, d):
    vp = datasets(spark, d).valid_points
    return finish(sequence.extrapolate_trip(vp, 2))


def q_destination_labels(spark, d):
    return datasets(spark, d).destination_labels()


def q_tte_labels(spark, d):
    return finish(datasets(spark, d).tte_labels())


def q_driver_labels(spark, d):
    return datasets(spark, d).driver_labels()


def _training_view(ds):
    return ds.training_view(POI_K)


def q_training_view(spark, d):
    """With the points reduced to what the oracle can compare."""
    tv = _training_view(datasets(spark, d))
    total = lambda c: F.aggregate("points", F.lit(0.0), lambda a, p: a + p[c])
    return finish(tv.withColumn("sum_lng", total("lng")).withColumn("sum_hour", total("seconds")).drop("points"))


def q_kseg_resample(spark, d):
    rows = datasets(spark, d).feature_rows
    return finish(rows.select("split", "trip", F.inline(sequence.kseg_array("pts", ["lng", "lat"], 6))))


def q_trip_vectors(spark, d):
    tv = datasets(spark, d).trip_vectors()
    return finish(tv.select("split", "trip", F.posexplode("vec").alias("i", "value")))


def q_next_point_pairs(spark, d):
    return finish(motion.next_point_rows(datasets(spark, d).trip_rows, ["lng", "road"]).select("trip", "pos", "lng", "next_lng", "next_road"))


def q_sequence_conv(spark, d):
    return finish(motion.conv_rows(datasets(spark, d).trip_rows, "speed", [0.25, 0.5, 0.25]).select("trip", "pos", "conv"))


def q_first_n_trips(spark, d):
    return datasets(spark, d).hop_trips(1000)


def q_hop_query_target(spark, d):
    hq = datasets(spark, d).hop_query_target(1000)
    return finish(hq.select("split", "idx", "trip", "role", "sub_pos", "lng", "lat", "speed"))


def q_query_target_union(spark, d):
    """U01 over the halves of every valid trip."""
    hq = sequence.hop_split(datasets(spark, d).trip_features)
    q = hq.where("role = 'qry'").drop("role")
    t = hq.where("role = 'tgt'").drop("role")
    u = split.query_target_union(q, t)
    return finish(u.select("split", "trip", "role", "sub_pos", "lng", "lat"))


def q_hop_query_target_pois(spark, d):
    return datasets(spark, d).hop_query_target_pois(HOP_N, POI_K)


def q_concat_sequences(spark, d):
    """R04 over the halves of every valid trip, each cut to its valid length."""
    hq = sequence.hop_split(datasets(spark, d).trip_features)
    s = sequence.trip_sequences(hq.withColumn("pos", F.col("sub_pos")), ["lng"], ("split", "trip", "role"))
    q = s.where("role = 'qry'").select("split", "trip", F.col("points").alias("a"), F.col("length").alias("na"))
    t = s.where("role = 'tgt'").select("split", "trip", F.col("points").alias("b"), F.col("length").alias("nb"))
    c = q.join(t, ["split", "trip"]).select("split", "trip", concat_valid("a", F.col("na"), "b", F.col("nb")).alias("c"))
    return finish(c.select("split", "trip", F.posexplode("c").alias("i", "p")).select(
        "split", "trip", "i", F.col("p.lng").alias("lng")))


def q_pad_trips(spark, d):
    ds = datasets(spark, d)
    # Pad every trip to its split's longest by repeating its last point
    s = ds.trip_sequences()
    L = s.groupBy("split").agg(F.max("length").alias("L"))
    p = s.join(F.broadcast(L), "split").select(
        "trip", pad_to(F.transform("points", lambda r: r["lng"]), F.col("L")).alias("arr"))
    return finish(p.select("trip", F.posexplode("arr").alias("i", "lng")))


def q_flatten_valid(spark, d):
    ds = datasets(spark, d)
    s = ds.trip_sequences().select("trip", "length",
                                                        F.transform("points", lambda r: r["speed"]).alias("arr"))
    return finish(sequence.flatten_valid(s, "arr", "length", ["trip"]).withColumnRenamed("value", "speed"))


def q_pairwise_distance(spark, d):
    ds = datasets(spark, d)
    vecs = ds.kseg_vectors()
    ht = ds.hop_trips(HOP_N)
    qs = ht.join(vecs, ["split", "trip"]).select("split", F.col("trip").alias("qid"), F.col("vec").alias("qv"))
    j = vecs.join(F.broadcast(qs), "split")     # queries: at most 3 * HOP_N rows
    return finish(j.select("split", "qid", F.col("trip").alias("item"), l2_distance("vec", "qv").alias("dist")))


def _per_split_queries(ds, n):
    vecs = ds.kseg_vectors()
    ht = ds.hop_trips(n)
    return vecs, ht


def q_near_set(spark, d):
    ds = datasets(spark, d)
    vecs, ht = _per_split_queries(ds, HOP_N)
    items = vecs.select("split", F.col("trip").alias("item"), "vec")
    qs = ht.join(vecs, ["split", "trip"]).select("split", F.col("trip").alias("qid"), "vec")
    r = search.vector_topk(qs, items, 10, group="split")
    return finish(r.join(F.broadcast(ht.select(F.col("trip").alias("qid"), "split")), "qid")
                  .select("split", "qid", "item", "rank", "dist"))


def q_farthest_negatives(spark, d):
    return datasets(spark, d).negatives(HOP_N, NEG_M, mode="farthest")


def q_sample_negatives(spark, d):
    return datasets(spark, d).negatives(HOP_N, NEG_M, seed=7, mode="uniform")


def q_search_candidates(spark, d):
    return finish(datasets(spark, d).search_scores(HOP_N, NEG_M, mode="farthest"))


def q_similar_search(spark, d):
    return finish(datasets(spark, d).similar_search(HOP_N, NEG_M, mode="farthest"))


def q_similar_search_sampled(spark, d):
    return finish(datasets(spark, d).similar_search(HOP_N, NEG_M, seed=7, mode="uniform"))


def q_pairwise(spark, d):
    """Consecutive point pairs of every valid trip."""
    return finish(motion.next_point_rows(datasets(spark, d).trip_rows, ["lng", "lat"]).select("trip", "pos", "lng", "lat", "next_lng", "next_lat"))


def q_od_poi_text(spark, d):
    """The place text of every valid trip's origin and destination (k = 3)."""
    ds = datasets(spark, d)
    pts = ds.od_points().withColumn("qid", F.col("trip") * 2 + F.when(F.col("end") == "d", 1).otherwise(0))
    txt = poi.poi_text(poi.knn_poi(pts.select("qid", "lng", "lat"), ds.fixture["pois"], POI_K))
    return txt.select(F.floor(F.col("qid") / 2).alias("trip"), F.when(F.col("qid") % 2 == 1, "d").otherwise("o").alias("end"), "text")


def q_negative_candidates(spark, d):
    """The negative candidates of each hop query (all but its 10 nearest)."""
    ds = datasets(spark, d)
    vecs, ht = _per_split_queries(ds, HOP_N)
    items = vecs.select("split", F.col("trip").alias("item"), "vec")
    qs = ht.join(vecs, ["split", "trip"]).select("split", F.col("trip").alias("qid"), "vec")
    near = search.nearest_set(qs, items, 10, group="split")
    return (items.join(F.broadcast(qs.select("split", "qid")), "split")       # at most 3 * HOP_N queries
            .join(near, ["qid", "item"], "left_anti").select("split", F.col("qid").alias("trip"), F.col("item").alias("neg_trip")))


def q_prompt_suffix(spark, d):
    """The task suffix of every valid trip, per task and language."""
    rows = [(t, l, v) for (t, l), v in TASK_SUFFIXES.items()]
    suf = spark.createDataFrame(rows, "task string, lang string, suffix string")
    return datasets(spark, d).valid.select("trip").crossJoin(F.broadcast(suf))


def q_farthest_negatives_default(spark, d):
    """'hopnegindex' with the reference defaults (N = 1000, M = 10000)."""
    return datasets(spark, d).negatives(1000, 10000, mode="farthest")


def q_similar_search_default(spark, d):
    """Search metrics with the reference defaults (N = 1000, M = 10000)."""
    return finish(datasets(spark, d).similar_search(1000, 10000, mode="farthest"))


def q_seeded_shuffle(spark, d):
    """A seeded order of each split's trips."""
    return split.seeded_shuffle(datasets(spark, d).valid.select("trip", "split"), 42, ["trip"], group="split")


def q_mean_pool(spark, d):
    return finish(sequence.mean_pool(_emb(spark, d), "vec", ["label"]))


def q_l2_similarity(spark, d):
    e = _emb(spark, d)
    c = _centroids(spark, d)
    j = e.join(c, e["label"] == c["cls"])
    return finish(j.select("vec_id", (-l2_distance("vec", "cvec")).alias("similarity")))


def q_argmax_class(spark, d):
    return metrics.argmax_class(_emb_scores(spark, d)).withColumnRenamed("id", "vec_id")


def q_score_rank(spark, d):
    r = metrics.score_rank(_emb_scores(spark, d))
    return r.select(F.col("id").alias("vec_id"), "cls", F.col("rank").cast("long").alias("rank"))


def _emb_labels(spark, d):
    return _emb(spark, d).select(F.col("vec_id").alias("id"), "label")


def _emb_rows(spark, d):
    """Embeddings with the scores of all label centroids on the row."""
    from ..operators.vectors import anchor_scores
    anchors = _centroids(spark, d).select(F.col("cls").alias("anchor"), F.col("cvec").alias("avec"))
    return anchor_scores(_emb(spark, d), anchors).select(F.col("vec_id").alias("id"), "label", "scores")


def q_classification_metrics(spark, d):
    return finish(metrics.metrics_of_examples(metrics.per_row(_emb_rows(spark, d))))


def q_topn_accuracy(spark, d):
    m = metrics.classification_metrics(_emb_scores(spark, d), _emb_labels(spark, d), ns=(2, 3))
    return finish(m.select("acc@2", "acc@3"))


def q_mean_rank(spark, d):
    r = metrics.per_row(_emb_rows(spark, d))
    return finish(r.select(F.col("id").alias("vec_id"), "rank"))


def q_cross_entropy(spark, d):
    return finish(metrics.entropy_of_rows(_emb_rows(spark, d)))


def _persistence(ds):
    return motion.next_point_rows(ds.feature_rows, ["lng", "lat"])


def q_multi_mse(spark, d):
    nxt = _persistence(datasets(spark, d))
    return finish(metrics.multi_mse(nxt, [("lng", "next_lng"), ("lat", "next_lat")]))


def q_recovery_loss(spark, d):
    """Each feature of the next points of the test trips, the words of their places, and the total."""
    return finish(datasets(spark, d).recovery_objective(POI_K))


def _tte_baseline(ds):
    """Predict every trip's travel time by the train-split mean (data-derived)."""
    t = ds.tte_labels()
    mean = t.where("split = 0").agg(F.avg("tte").alias("pred"))
    return t.crossJoin(F.broadcast(mean)).withColumnRenamed("tte", "label")


def q_regression_metrics(spark, d):
    return finish(metrics.regression_metrics(_tte_baseline(datasets(spark, d)), keys=("split",)))


def q_selection_score(spark, d):
    m = metrics.regression_metrics(_tte_baseline(datasets(spark, d)), keys=("split",))
    return finish(metrics.selection_score(m, "regression").select("split", "mape", "score"))


def q_set_intersection(spark, d):
    vp = datasets(spark, d).valid_points
    a = vp.where("split < 2").select("road")
    b = vp.where("split = 2").select("road")
    return split.set_intersection(a, b)


def q_new_vocabulary(spark, d):
    """Anchor words and virtual words not yet among the words of the place texts and documents."""
    pois = datasets(spark, d).fixture["pois"].select(F.concat_ws(" ", "name", "address").alias("text"))
    texts = pois.unionByName(spark.read.parquet(f"{d}/documents.parquet").select("text"))
    vocab = texts.select(F.explode(F.split(F.lower("text"), "[^a-z0-9#-]+")).alias("word")).where(F.length("word") > 0).distinct()
    en = split.new_vocabulary(vocab, ANCHOR_WORDS, len(ANCHOR_WORDS), 4)
    return en.unionByName(split.new_vocabulary(vocab, ANCHOR_WORDS_ZH, 12, 0))


def q_vocabulary_difference(spark, d):
    """Words of the conversations that the documents' vocabulary lacks."""
    words = lambda name: (spark.read.parquet(f"{d}/{name}.parquet").select(F.explode(F.split(F.lower("text"), "[^a-z0-9]+")).alias("word"))
                          .where(F.length("word") > 0).distinct())
    return split.set_difference(words("conversations"), words("documents"), "word")


def q_prompt_prefix(spark, d):
    tv = _training_view(datasets(spark, d))
    return tv.select("trip", prompts.prefix(F.col("start_weekday"), F.col("start_hour"), "zh").alias("prefix_zh"),
                     prompts.prefix(F.col("start_weekday"), F.col("start_hour"), "en").alias("prefix_en"))


def q_prompt_eval(spark, d):
    return prompts.eval_prompts(_training_view(datasets(spark, d))).select("trip", "task", prompts.as_text().alias("prompt"))


def q_prompt_eval_en(spark, d):
    return prompts.eval_prompts(_training_view(datasets(spark, d)), "en").select("trip", "task", prompts.as_text().alias("prompt"))


def q_prompt_pretrain(spark, d):
    return prompts.pretrain_prompts(_training_view(datasets(spark, d))).select("trip", "recover_type", prompts.as_text().alias("prompt"))


def q_prompt_pretrain_no_places(spark, d):
    """T03 without places, with the points as an array (here: how many)."""
    tv = prompts.pretrain_prompts(_training_view(datasets(spark, d)), "en", places=False)
    return tv.select("trip", "recover_type", "before", F.size("points").alias("n_points"), "after")


def q_embedding_lookup(spark, d):
    """Road embedding (its lng/lat) + weekday position encoding, summed."""
    ds = datasets(spark, d)
    ri = ds.fixture["road_info"].select("road", F.array("lng", "lat").alias("road_vec"))
    vp = ds.valid_points.join(ri, "road")   # Spark sizes the road table
    e = vp.select("trip", "pos", F.zip_with("road_vec", encodings.position_encoding(F.col("weekday").cast("double"), 2),
                                             lambda a, b: a + b).alias("e"))
    return finish(e.select("trip", "pos", F.col("e")[0].alias("e0"), F.col("e")[1].alias("e1")))


def q_anchor_attention(spark, d):
    """Each embedding attends over the label centroids (anchors)."""
    from ..operators.vectors import anchor_attention
    anchors = _centroids(spark, d).select(F.col("cls").alias("anchor"), F.col("cvec").alias("avec"))
    out = anchor_attention(_emb(spark, d).select("vec_id", "vec"), anchors)
    return finish(out.select("vec_id", F.posexplode("attended").alias("i", "value")))


def q_meta_roundtrip(spark, d):
    from ..sources.io import read_meta, write_meta
    ds = datasets(spark, d)
    path = write_meta(ds.trip_features, "trip")
    return finish(read_meta(spark, path, split=2))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    k[2:]: v for k, v in sorted(globals().items()) if k.startswith("q_") and callable(v)
}


# ---- keys checked by rows and by their own tests (no SQL oracle) -----------
def q_destination_model(spark, d):
    """M01 + M07: destination road from the cut trip (LogisticRegression)."""
    from .tasks import classification_task
    ds = datasets(spark, d)
    return finish(classification_task(ds, ds.destination_labels(), "destination", pre_length=PRE_LENGTH))


def q_driver_model(spark, d):
    """M04 + M07: driver class of a trip."""
    from .tasks import classification_task
    ds = datasets(spark, d)
    return finish(classification_task(ds, ds.driver_labels(), "driver"))


def q_tte_model(spark, d):
    """M02 + M07: travel time (GBTRegressor)."""
    from .tasks import regression_task
    return finish(regression_task(datasets(spark, d), "gbt"))


def q_encode_trips(spark, d):
    """A caller's batch encoder over whole trips (mapInPandas)."""
    from ..operators.vectors import encode_trips, summary_encoder
    return finish(encode_trips(datasets(spark, d).feature_rows, ["lng", "lat", "speed"], lambda: summary_encoder, 12)
                  .select("trip", F.posexplode("vec").alias("i", "value")))


ANN = {"k": 10, "refine": 4}       # probes: as many as a sample needs


def q_ann_search(spark, d):
    """About the 10 nearest embeddings of every one whose id is divisible by
    50, by the inverted file over all of them."""
    from ..operators.ivf import ann_topk
    items = _emb(spark, d).select(F.col("vec_id").alias("item"), "vec")
    qs = items.where("item % 50 = 0").select(F.col("item").alias("qid"), "vec")
    return finish(ann_topk(qs, items, **ANN))


def q_metrics_table(spark, d):
    """Metrics of two tasks appended to one long table and read back."""
    import uuid

    from ..sources.io import append_metrics, default_root
    ds = datasets(spark, d)
    path = f"{default_root(spark)}/metrics-{uuid.uuid4().hex[:8]}"
    append_metrics(ds.similar_search(HOP_N, NEG_M, mode="farthest"), "search", path)
    append_metrics(metrics.regression_metrics(_tte_baseline(ds), keys=("split",)), "tte_baseline", path)
    return finish(spark.read.parquet(path))


def q_select_model(spark, d):
    """Travel time by a model fitted in rounds; the best round on the validation split, with a patience of 5."""
    from .tasks import patient_regression
    return finish(patient_regression(datasets(spark, d), patience=5, max_rounds=30))


QUERIES.update({k[2:]: v for k, v in list(globals().items())
                if k.startswith("q_") and callable(v) and k[2:] not in QUERIES})
