"""Named derived datasets of the reference, as lazy DataFrame plans.

    load -> time features -> split (ordinal) -> valid trips (grouped check)
         -> K01 on all trips, written once -> one row per valid trip (array of points)
         -> offset, fill, scale -> trip / destination / tte / odpois / hop / negatives / search

Trips are bounded by the length filter, so everything about one trip is an
expression on its array: no dataset shuffles the points again.

The scaling statistics are computed over *all* trips (as the reference's
expanded statistics) with the chunked K01 plan, which bounds every window
partition even when one trip holds a large share of the points.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import session
from ..constants import (CONTINUOUS_COLS, FEATURE_COLS, KSEG, MAX_TRIP_LEN, MIN_TRIP_LEN, NEAR_EXCLUSION,
                         NORMALIZED_COLS, POI_SEPARATOR, TRIP_COLS)
from ..functions.temporal import hour
from ..operators import grid, motion, poi, recovery, search, sequence, split, stats
from ..operators.metrics import classification_metrics
from ..session import cut_lineage

RAW_COLS = ["time", "road", "road_prop", "lng", "lat", "seq_i"]
NUMERIC_POINT_COLS = ["trip", "road", "road_prop", "lng", "lat", "seq_i", "seconds", "tod",
                      "weekday", "speed", "acceleration", "heading_angle"]
POINT_COLS = ["time", "seq_i", "road", "road_prop", "lng", "lat", "seconds", "tod", "weekday",
              "speed", "acceleration", "heading_angle"]
EMBED_KSEG = MIN_TRIP_LEN // 2   # hopped halves of valid trips have >= 3 points


class TripDatasets:
    """All derived datasets of one city, built lazily from the four tables."""

    def __init__(self, trips: DataFrame, trip_info: DataFrame, road_info: DataFrame | None = None,
                 pois: DataFrame | None = None, heading: str = "reference",
                 min_len: int = MIN_TRIP_LEN, max_len: int = MAX_TRIP_LEN,
                 materialize: bool = True, chunk_rows: int = 200_000, road_type: str = "road_network", order: str = "trip"):
        if road_type not in ("road_network", "grid"):
            raise ValueError(f"unknown road type {road_type!r}")
        self.dims = None
        if road_type == "grid":          # P15/P16: cells take the place of the roads
            self.dims = grid.grid_dims(trips)
            trips = grid.project_to_grid(trips, self.dims)
            road_info = grid.grid_cells(self.dims)
        self.materialize, self.order = materialize, order
        self.chunk_rows = chunk_rows
        self.trips = trips
        self.trip_info = trip_info
        self.road_info = road_info
        self.pois = pois
        self.heading = heading
        self.min_len, self.max_len = min_len, max_len
        self.spark = trips.sparkSession
        self._memo: dict = {}
        self._written: list[str] = []

    def _keep(self, df: DataFrame, by_split: bool = False) -> DataFrame:
        """Write a table reused by several datasets to the checkpoint folder
        (shared storage on a cluster), cutting its lineage; per-split tables
        are partitioned by split so reading one split prunes partitions."""
        if not self.materialize:
            return df
        mark = session.written_tables()
        out = cut_lineage(df, partition_by="split" if by_split else None)
        self._written += session.written_since(mark)
        return out

    def close(self) -> None:
        """Delete the tables that this object wrote; it can't be used afterwards."""
        session.drop_tables(self.spark, self._written)
        self._written.clear()

    def _small(self, df: DataFrame, bound: int) -> DataFrame:
        """A result with a proven size bound (statistics row, hop trip list)
        held as a local relation: one collect, lineage cut, no file write."""
        rows = df.limit(bound + 1).collect()
        if len(rows) > bound:
            return self._keep(df)
        return self.spark.createDataFrame(rows, df.schema)

    # ---- base tables -------------------------------------------------------
    @cached_property
    def points(self) -> DataFrame:
        """Raw points with seconds, tod, weekday."""
        return motion.add_time_features(self.trips)

    @cached_property
    def split_info(self) -> DataFrame:
        """trip, driver, split (F03), by the rows' order in ``order`` (a column of trip_info)."""
        return self._keep(split.assign_split(self.trip_info, self.order))

    @cached_property
    def validity(self) -> DataFrame:
        """Per trip: length, NULL rows, first/last second and the verdict, in
        one map-side combined aggregate (shared by the validity filter and the
        long-trip detection of K01)."""
        any_null = F.lit(False)
        for c in RAW_COLS:
            any_null = any_null | F.col(c).isNull()
        agg = self.points.groupBy("trip").agg(
            F.count(F.lit(1)).alias("length"), F.count_if(any_null).alias("null_rows"),
            F.min("seconds").alias("s0"), F.max("seconds").alias("s1"))
        ok = (F.col("null_rows") == 0) & F.col("length").between(self.min_len, self.max_len)
        return self._keep(agg.withColumn("valid", ok))

    @cached_property
    def valid(self) -> DataFrame:
        """trip, length, split of valid trips (F02 per split)."""
        v = self.validity.where("valid")
        return self._keep(v.join(self.split_info.select("trip", "split"), "trip")
                          .select("trip", "split", "length"))

    @cached_property
    def motion_all(self) -> DataFrame:
        """K01 over every trip, skew-safe plan, written once: the scaling
        statistics, every pass of ``describe_all`` and the valid trips are
        column-pruned scans of it."""
        return self._keep(motion.motion_features_all(self.points, self.heading, chunk_rows=self.chunk_rows,
                                                     trip_stats=self.validity))

    @cached_property
    def norm_stats(self) -> DataFrame:
        """One row of min/max for the scaled columns over all points."""
        return self._small(stats.minmax_stats(self.motion_all, NORMALIZED_COLS), 1)

    def cardinalities(self) -> DataFrame:
        """num_road, num_class; for the grid type also num_w, num_h."""
        if self.dims is not None:
            return grid.cardinalities_grid(self.road_info, self.trip_info, self.dims)
        return stats.cardinalities(self.road_info, self.trip_info)

    def describe_all(self, quantiles: str = "exact") -> DataFrame:
        """A01 over all points after K01 (the expanded statistics)."""
        return stats.describe(self.motion_all, NUMERIC_POINT_COLS, quantiles)

    @cached_property
    def trip_rows(self) -> DataFrame:
        """split, trip, n, pts: one row per valid trip, its points with K01 in
        order; written once partitioned by split. The filter to valid trips
        comes before the grouping, so no array grows beyond ``max_len``."""
        pts = self.motion_all.join(self.valid.select("trip", "split"), "trip")
        rows = pts.groupBy("trip").agg(F.first("split").alias("split"), F.array_sort(F.collect_list(F.struct(*POINT_COLS))).alias("pts"))
        return self._keep(rows.select("split", "trip", F.size("pts").alias("n"), "pts"), by_split=True)

    @cached_property
    def valid_points(self) -> DataFrame:
        """Points of valid trips with split, K01, pos, n, s0, s1 (long form of ``trip_rows``)."""
        ends = [F.col("pts")[0]["seconds"].alias("s0"), F.element_at("pts", -1)["seconds"].alias("s1")]
        return (self.trip_rows.select("split", "trip", "n", *ends, F.posexplode("pts").alias("pos", "p"))
                .select("split", "trip", "n", "s0", "s1", "pos", "p.*"))

    # ---- trip meta ---------------------------------------------------------
    @cached_property
    def trip_features(self) -> DataFrame:
        """'trip' meta in long form: split, trip, pos, n + 12 features.

        TRIP_COLS with missing values as 0, offset = (t - t0)/(tN - t0)*2 - 1
        (NULL for a zero span), then min-max scaling of the six columns.
        """
        return (self.feature_rows.select("split", "trip", "n", F.posexplode("pts").alias("pos", "p"))
                .select("split", "trip", "pos", "n", "p.*"))

    @cached_property
    def feature_rows(self) -> DataFrame:
        """``trip_features`` as one row per trip: split, trip, n, pts."""
        s0, s1 = F.col("pts")[0]["seconds"], F.element_at("pts", -1)["seconds"]

        def features(p):
            cols = {c: F.coalesce(p[c].cast("double"), F.lit(0.0)) for c in TRIP_COLS}
            cols["offset"] = F.try_divide(p["seconds"] - s0, s1 - s0) * 2 - 1
            for c in NORMALIZED_COLS:
                low, high = F.col(f"min_{c}"), F.col(f"max_{c}")
                cols[c] = F.try_divide(cols[c] - low, high - low) * 2 - 1
            return F.struct(*[cols[c].alias(c) for c in FEATURE_COLS])

        rows = self.trip_rows.crossJoin(F.broadcast(self.norm_stats))       # one row of statistics
        return rows.select("split", "trip", "n", F.transform("pts", features).alias("pts"))

    def trip_sequences(self) -> DataFrame:
        """One row per trip, its 12-feature points in order."""
        return self.feature_rows.select("split", "trip", F.col("pts").alias("points"), F.col("n").alias("length"))

    # ---- labels ------------------------------------------------------------
    def destination_labels(self) -> DataFrame:
        """Road of the last point (raw id)."""
        return self.trip_rows.select("split", "trip", F.element_at("pts", -1)["road"].cast("long").alias("destination"))

    def tte_labels(self) -> DataFrame:
        """Last minus first ``seconds`` of the trip, in seconds."""
        return self.trip_rows.select("split", "trip", (F.element_at("pts", -1)["seconds"] - F.col("pts")[0]["seconds"]).alias("tte"))

    def driver_labels(self) -> DataFrame:
        """Driver class of each valid trip."""
        return self.valid.join(self.split_info.select("trip", "driver"), "trip").select("split", "trip", "driver")

    def training_view(self, k: int = 3, label: str | None = None) -> DataFrame:
        """What a model is given of each trip: points (``seconds`` as hour of
        day), length, place texts, start context and labels; ``label`` (one of
        destination, tte, driver) keeps that one only, as ``label``."""
        first, last = F.col("pts")[0], F.element_at("pts", -1)
        per = self.feature_rows.select(
            "split", "trip", F.col("n").cast("long").alias("length"), first["weekday"].cast("int").alias("start_weekday"),
            hour(first["seconds"]).alias("start_hour"), last["road"].cast("long").alias("destination"),
            (last["seconds"] - first["seconds"]).alias("tte"),
            F.transform("pts", lambda p: p.withField("seconds", hour(p["seconds"]).cast("double"))).alias("points"))
        view = per.join(self.od_pois(k).drop("split"), "trip").join(self.split_info.select("trip", "driver"), "trip")
        if label is None:
            return view
        if label not in ("destination", "tte", "driver"):
            raise ValueError(f"no label {label!r}")
        return view.withColumn("label", F.col(label)).drop("destination", "tte", "driver")

    def recovery_objective(self, k: int = 3, dis_weight: float = 0.5, con_weight: float = 0.5, places: bool = True) -> DataFrame:
        """A16 of the test trips: kind, feature, weight, loss, n, and the total.

        Cross entropy of the next road (given the road, then weekday and hour),
        weekday and hour (given both, then the road), mean squared error of the
        next scaled features by ridge regression on the present ones, and cross
        entropy of the words of the origin's and destination's place texts
        (given the start's weekday and hour). All learn on the train trips.
        """
        raw = motion.next_point_rows(self.feature_rows, ["road", "weekday", "seconds", *CONTINUOUS_COLS]).where("split IN (0, 2)")
        whole = lambda c: F.col(c).cast("long")
        nxt = raw.select("split", *[whole(c).alias(c) for c in ("road", "weekday", "next_road", "next_weekday")],
                         hour("seconds").alias("hour"), hour("next_seconds").alias("next_hour"),
                         *CONTINUOUS_COLS, *[f"next_{c}" for c in CONTINUOUS_COLS])
        train, test = F.col("split") == 0, F.col("split") == 2
        clock = ("weekday", "hour")
        n_road = self.cardinalities().first()["num_road"]
        entropy = lambda rows, name, target, *args: recovery.backoff_cross_entropy(rows, target, *args).withColumn("feature", F.lit(name))
        parts = [("discrete", dis_weight, entropy(nxt, "road", "next_road", [("road",), clock], train, test, n_road)),
                 ("discrete", dis_weight, entropy(nxt, "weekday", "next_weekday", [clock, ("road",)], train, test, 7)),
                 ("discrete", dis_weight, entropy(nxt, "hour", "next_hour", [clock, ("road",)], train, test, 24))]
        targets = [f"next_{c}" for c in CONTINUOUS_COLS]
        fit = recovery.ridge_fit(nxt.where(train), CONTINUOUS_COLS, targets)
        errors = recovery.ridge_errors(nxt.where(test), CONTINUOUS_COLS, targets, fit)
        parts.append(("continuous", con_weight / len(targets), errors.withColumn("feature", F.expr("substring(feature, 6)"))))
        if places:
            view = self.training_view(k)
            for end in ("o", "d"):
                words = view.select("split", "start_weekday", "start_hour", F.explode(F.split(f"{end}_text", f"{POI_SEPARATOR}| ")).alias("word"))
                parts.append(("place", 1.0, entropy(words, f"{end}_text", "word", [("start_weekday", "start_hour")], train, test)))
        return recovery.objective(parts)

    # ---- origin / destination places --------------------------------------
    def od_points(self, pre_length: int = 0, momentum: bool = False) -> DataFrame:
        """Origin = first point; destination = last point of the trip cut by
        1 + pre_length (Q3), or its momentum extrapolation (W06)."""
        rows = self.trip_rows
        o = rows.select("split", "trip", F.lit("o").alias("end"), F.col("pts")[0]["lng"].alias("lng"), F.col("pts")[0]["lat"].alias("lat"))
        if momentum and pre_length >= 1:
            ex = sequence.extrapolate_trip(self.valid_points, pre_length).where(F.col("step") == pre_length)
            d = ex.join(self.valid.select("trip", "split"), "trip").select(
                "split", "trip", F.lit("d").alias("end"), "lng", "lat")
        else:
            last = F.get("pts", F.col("n") - 2 - pre_length)
            d = rows.where(F.col("n") >= 2 + pre_length).select(
                "split", "trip", F.lit("d").alias("end"), last["lng"].alias("lng"), last["lat"].alias("lat"))
        return o.unionByName(d)

    def od_pois(self, k: int = 5, pre_length: int = 0, momentum: bool = False,
                pois: DataFrame | None = None, only: DataFrame | None = None, splits: tuple[int, ...] | None = None) -> DataFrame:
        """M00 'odpois-k[-pre[-momentum]]': split, trip, o_text, d_text.

        ``only`` (a small table of trips, e.g. the hop set) or ``splits`` restrict
        the neighbour search to those trips before it runs."""
        pois = pois if pois is not None else self.pois
        pts = self.od_points(pre_length, momentum)
        if splits is not None:
            pts = pts.where(F.col("split").isin(*splits))
        if only is not None:
            pts = pts.join(F.broadcast(only.select("trip")), "trip", "left_semi")
        pts = self._keep(pts.withColumn(          # two rows a trip: read twice, the arrays once
            "qid", F.col("trip") * 2 + F.when(F.col("end") == "d", 1).otherwise(0)))
        nb = poi.knn_poi(pts.select("qid", "lng", "lat"), pois, k)
        txt = poi.poi_text(nb)
        j = pts.join(txt, "qid", "left")
        return (j.groupBy("split", "trip")
                .agg(F.max(F.when(F.col("end") == "o", F.col("text"))).alias("o_text"),
                     F.max(F.when(F.col("end") == "d", F.col("text"))).alias("d_text")))

    # ---- hop query / target -----------------------------------------------
    def hop_trips(self, n: int = 1000) -> DataFrame:
        """Split, trip, idx of the first min(len-1, n) valid trips."""
        key = ("hop", n)
        if key not in self._memo:
            self._memo[key] = self._small(sequence.first_n_trips(self.valid.select("trip", "split"), n),
                                          3 * n)        # at most n trips per split
        return self._memo[key]

    def hop_query_target(self, n: int = 1000) -> DataFrame:
        """R02 'hopqrytgt-n' in long form: role qry = even points, tgt = odd."""
        ht = self.hop_trips(n).select("trip", "idx")
        tf = self.trip_features.join(F.broadcast(ht), "trip")   # at most 3n trips
        return sequence.hop_split(tf)

    def hop_query_target_pois(self, n: int = 1000, k: int = 5, splits: tuple[int, ...] | None = None) -> DataFrame:
        """R03 'hopqrytgtpois-n-k': POI texts of the hop trips, per role (Q6 fixed)."""
        ht = self.hop_trips(n).select("split", "trip", "idx")
        if splits is not None:
            ht = ht.where(F.col("split").isin(*splits))
        od = self.od_pois(k, only=ht).drop("split")              # only the <= 3n hop trips
        roles = self.spark.createDataFrame([("qry",), ("tgt",)], "role string")
        return ht.join(od, "trip").crossJoin(F.broadcast(roles))

    # ---- vectors, negatives, search ---------------------------------------
    def kseg_vectors(self, k: int = KSEG, rows: DataFrame | None = None,
                     keys: tuple[str, ...] = ("split", "trip")) -> DataFrame:
        """A07 over scaled lng/lat (k*2 values, Q17): an expression on each trip's
        row; those of all trips are written once for the searches that read them."""
        if rows is None and keys == ("split", "trip"):
            if ("kseg", k) not in self._memo:
                self._memo["kseg", k] = self._keep(self.kseg_vectors(k, self.feature_rows))
            return self._memo["kseg", k]
        rows = self.feature_rows if rows is None else rows
        return rows.select(*keys, sequence.kseg_vector("pts", ["lng", "lat"], k).alias("vec"))

    def negatives(self, n: int = 1000, m: int = 10000, seed: int = 0,
                  mode: str = "uniform", splits: tuple[int, ...] | None = None) -> DataFrame:
        """G03 'hopnegindex-n-m': split, qry trip, neg trip, neg_idx.

        All splits (or the given ones) in one pass: queries draw only from their own split.
        """
        vecs = self.kseg_vectors()
        ht = self.hop_trips(n)
        if splits is not None:
            vecs, ht = vecs.where(F.col("split").isin(*splits)), ht.where(F.col("split").isin(*splits))
        items = vecs.select("split", F.col("trip").alias("item"), "vec")
        qs = ht.join(vecs, ["split", "trip"]).select("split", F.col("trip").alias("qid"), "vec")
        neg = search.sample_negatives(qs, items, m, seed, NEAR_EXCLUSION, mode, group="split")
        return (neg.join(F.broadcast(ht.select(F.col("trip").alias("qid"), "split")), "qid")
                .select("split", F.col("qid").alias("trip"), F.col("item").alias("neg_trip"), "neg_idx"))

    def trip_vectors(self, k: int = EMBED_KSEG) -> DataFrame:
        """M06 default trip vector: k-segment means of scaled lng/lat."""
        return self.kseg_vectors(k)

    def search_scores(self, n: int = 1000, m: int = 10000, seed: int = 0,
                      mode: str = "uniform") -> DataFrame:
        """M03 scores in long form: split, qid (query trip), cls, score."""
        ht = self.hop_trips(n).select("trip")
        rows = self.feature_rows.join(F.broadcast(ht), "trip")               # at most 3n trips
        half = lambda odd: self.kseg_vectors(EMBED_KSEG, rows.withColumn(
            "pts", F.filter("pts", lambda _, i: i % 2 == odd))).select("split", F.col("trip").alias("qid"), "vec")
        qv, tv = half(0), half(1)
        iv = self.trip_vectors().select("split", F.col("trip").alias("item"), "vec")
        neg = self.negatives(n, m, seed, mode).select("split", F.col("trip").alias("qid"),
                                                      F.col("neg_trip").alias("item"), "neg_idx")
        from ..functions.arrays import l2_distance
        t = (qv.join(tv.withColumnRenamed("vec", "_t"), ["split", "qid"])
             .select("split", "qid", F.lit(0).alias("cls"), (-l2_distance("vec", "_t")).alias("score")))
        ng = (neg.join(iv.withColumnRenamed("vec", "_n"), ["split", "item"])
              .join(qv, ["split", "qid"])
              .select("split", "qid", F.col("neg_idx").alias("cls"), (-l2_distance("vec", "_n")).alias("score")))
        return t.unionByName(ng)

    def similar_search(self, n: int = 1000, m: int = 10000, seed: int = 0,
                       mode: str = "uniform") -> DataFrame:
        """M03 metrics per split: mean_rank, macro_f1, macro_rec, acc@1/5/10."""
        # queries x (m + 1) rows, read by several metric branches: keep once
        sc = self._keep(self.search_scores(n, m, seed, mode))
        labels = sc.select("split", "qid").distinct().withColumn("label", F.lit(0))
        return classification_metrics(sc, labels, keys=("split", "qid"), group=("split",))
