"""Queries on matching, average precision, reports and their window idioms."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators.matching import match_greedy
from ..operators.transfer import map_back, transfer_labels
from ..operators.validate import validate_holds, with_confidence
from ..plans import detection as d
from ..plans import reports as rep
from ..plans import routes as rt
from ..skew import chunked, differences, ranked, row_numbers, running_sum
from ..sources.files import largest_per_key, top_images
from . import views as w
from .geometry_queries import iou_table
from .views import HOLDS_SQL, IOU_SQL, r6

Q: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        Q[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


DETECTORS = ("click", "view")
LEVELS = "(VALUES (0.5::DOUBLE), (0.55), (0.6), (0.65), (0.7), (0.75), (0.8), (0.85), (0.9), (0.95)) AS lv(threshold)"

# Sequential greedy matching per detector and image, as a walk over the sorted candidates.
MATCH_SQL = """
cand AS (SELECT implementation_id, image_id, pred_idx, ann_idx, iou, row_number() OVER (PARTITION BY implementation_id, image_id
  ORDER BY iou DESC, pred_idx DESC, ann_idx DESC) AS n FROM iou WHERE iou >= 0.5),
walk AS (SELECT implementation_id, image_id, 0::BIGINT AS n, CAST([] AS BIGINT[]) AS up, CAST([] AS BIGINT[]) AS ua, false AS hit
    FROM (SELECT DISTINCT implementation_id, image_id FROM cand)
  UNION ALL SELECT w.implementation_id, w.image_id, c.n,
    CASE WHEN list_contains(w.up, c.pred_idx) OR list_contains(w.ua, c.ann_idx) THEN w.up ELSE list_append(w.up, c.pred_idx) END,
    CASE WHEN list_contains(w.up, c.pred_idx) OR list_contains(w.ua, c.ann_idx) THEN w.ua ELSE list_append(w.ua, c.ann_idx) END,
    NOT (list_contains(w.up, c.pred_idx) OR list_contains(w.ua, c.ann_idx))
    FROM walk w JOIN cand c ON c.implementation_id = w.implementation_id AND c.image_id = w.image_id AND c.n = w.n + 1),
m AS (SELECT c.* FROM walk w JOIN cand c ON c.implementation_id = w.implementation_id AND c.image_id = w.image_id AND c.n = w.n WHERE w.hit)
"""

# The same walk in confidence order for every threshold, then the precision curve.
AP_SQL = f"""
lev AS (SELECT threshold FROM {LEVELS}),
cand AS (SELECT threshold, implementation_id, image_id, pred_idx, ann_idx, row_number() OVER (PARTITION BY threshold, implementation_id, image_id
  ORDER BY conf DESC, pred_idx, iou DESC, ann_idx DESC) AS n FROM iou JOIN lev ON iou >= threshold),
walk AS (SELECT threshold, implementation_id, image_id, 0::BIGINT AS n, CAST([] AS BIGINT[]) AS up, CAST([] AS BIGINT[]) AS ua, false AS hit
    FROM (SELECT DISTINCT threshold, implementation_id, image_id FROM cand)
  UNION ALL SELECT w.threshold, w.implementation_id, w.image_id, c.n,
    CASE WHEN list_contains(w.up, c.pred_idx) OR list_contains(w.ua, c.ann_idx) THEN w.up ELSE list_append(w.up, c.pred_idx) END,
    CASE WHEN list_contains(w.up, c.pred_idx) OR list_contains(w.ua, c.ann_idx) THEN w.ua ELSE list_append(w.ua, c.ann_idx) END,
    NOT (list_contains(w.up, c.pred_idx) OR list_contains(w.ua, c.ann_idx))
    FROM walk w JOIN cand c ON c.threshold = w.threshold AND c.implementation_id = w.implementation_id AND c.image_id = w.image_id AND c.n = w.n + 1),
hits AS (SELECT DISTINCT c.threshold, c.implementation_id, c.image_id, c.pred_idx FROM walk w JOIN cand c ON c.threshold = w.threshold
  AND c.implementation_id = w.implementation_id AND c.image_id = w.image_id AND c.n = w.n WHERE w.hit),
cond AS (SELECT image_id, CASE WHEN condition = 'clean' THEN 'clean' ELSE 'distorted' END AS condition FROM im),
truths AS (SELECT condition, count(*) AS truths FROM a JOIN cond USING (image_id) GROUP BY 1),
det AS (SELECT p.event_type AS implementation_id, condition, p.image_id, p.hold_index AS pred_idx,
  row_number() OVER (PARTITION BY p.event_type, condition ORDER BY conf DESC, p.image_id, p.hold_index) AS rank
  FROM p JOIN cond USING (image_id) WHERE p.image_id IN (SELECT image_id FROM a)),
seq AS (SELECT d.*, lev.threshold, CASE WHEN h.pred_idx IS NULL THEN 0 ELSE 1 END AS tp FROM det d CROSS JOIN lev LEFT JOIN hits h
  ON h.threshold = lev.threshold AND h.implementation_id = d.implementation_id AND h.image_id = d.image_id AND h.pred_idx = d.pred_idx),
cum AS (SELECT *, sum(tp) OVER (PARTITION BY threshold, implementation_id, condition ORDER BY rank) AS ctp FROM seq),
env AS (SELECT *, max(ctp / CAST(rank AS DOUBLE)) OVER (PARTITION BY threshold, implementation_id, condition ORDER BY rank
  ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS envelope FROM cum),
ap AS (SELECT implementation_id, condition, threshold, sum(tp * envelope) / max(truths) AS ap FROM env JOIN truths USING (condition) GROUP BY 1, 2, 3)
"""


def labelled_predictions(spark, sf):
    return with_confidence(w.predictions(spark, sf)).withColumn("pred_idx", F.col("hold_index"))


def truth_rows(spark, sf):
    return w.annotations(spark, sf).select("image_id", F.col("hold_index").alias("ann_idx"), "route_id")


def conditions(spark, sf):
    return w.images(spark, sf).select("image_id", d.reported_condition(F.col("condition")).alias("condition"))


def matches(spark, sf):
    return match_greedy(iou_table(spark, sf, 0.5), 0.5, ["implementation_id", "image_id"])


def ap_table(spark, sf, predictions=None):
    cond = conditions(spark, sf)
    return d.average_precision(
        (labelled_predictions(spark, sf) if predictions is None else predictions).join(cond, "image_id"),
        truth_rows(spark, sf).join(cond, "image_id"),
        iou_table(spark, sf, 0.5).join(cond, "image_id"),
    )


@query("evl_match", f"WITH RECURSIVE {HOLDS_SQL}, {IOU_SQL}, {MATCH_SQL} SELECT implementation_id, image_id, pred_idx, ann_idx, round(iou, 6) AS iou FROM m")
def _(spark, sf):
    return matches(spark, sf).select("implementation_id", "image_id", "pred_idx", "ann_idx", r6("iou"))


@query("evl_counts", f"""WITH RECURSIVE {HOLDS_SQL}, {IOU_SQL}, {MATCH_SQL},
  pc AS (SELECT event_type AS implementation_id, image_id, count(*) AS np FROM p GROUP BY 1, 2), ac AS (SELECT image_id, count(*) AS na FROM a GROUP BY 1),
  mc AS (SELECT implementation_id, image_id, count(*) AS nm, avg(iou) AS mi FROM m GROUP BY 1, 2),
  u AS (SELECT s.implementation_id, im.image_id, coalesce(np, 0) AS np, coalesce(na, 0) AS na, coalesce(nm, 0) AS nm, coalesce(mi, 0) AS mi FROM im
    CROSS JOIN (VALUES ('view'), ('click')) AS s(implementation_id) LEFT JOIN pc ON pc.image_id = im.image_id AND pc.implementation_id = s.implementation_id
    LEFT JOIN ac ON ac.image_id = im.image_id LEFT JOIN mc ON mc.image_id = im.image_id AND mc.implementation_id = s.implementation_id)
  SELECT implementation_id, image_id, nm AS true_positives, np - nm AS false_positives, na - nm AS false_negatives,
  round(CASE WHEN np > 0 THEN nm / CAST(np AS DOUBLE) ELSE 0 END, 6) AS precision, round(CASE WHEN na > 0 THEN nm / CAST(na AS DOUBLE) ELSE 0 END, 6) AS recall,
  round(CASE WHEN np + na > 0 THEN 2 * nm / CAST(np + na AS DOUBLE) ELSE 0 END, 6) AS f1, round(mi, 6) AS mean_matched_iou FROM u WHERE np + na > 0""")
def _(spark, sf):
    per_detector = truth_rows(spark, sf).withColumn("implementation_id", d.each(DETECTORS))
    table = d.detection_metrics(
        labelled_predictions(spark, sf), per_detector, matches(spark, sf), ["implementation_id", "image_id"]
    )
    return table.select(
        "implementation_id", "image_id", "true_positives", "false_positives", "false_negatives",
        r6("precision"), r6("recall"), r6("f1"), r6("mean_matched_iou"),
    )


@query("evl_ap", f"WITH RECURSIVE {HOLDS_SQL}, {IOU_SQL}, {AP_SQL} SELECT implementation_id, condition, threshold, round(ap, 6) AS ap FROM ap")
def _(spark, sf):
    return ap_table(spark, sf).select("implementation_id", "condition", "threshold", r6("ap"))


# Without confidences all detections tie and the order of the cases decides.
TIED_SQL = AP_SQL.replace("ORDER BY conf DESC, p.image_id,", "ORDER BY p.image_id DESC,").replace("ORDER BY conf DESC, pred_idx,", "ORDER BY pred_idx,")


@query("evl_ap_case_order", f"WITH RECURSIVE {HOLDS_SQL}, {IOU_SQL}, {TIED_SQL} SELECT implementation_id, condition, threshold, round(ap, 6) AS ap FROM ap")
def _(spark, sf):
    """Fallback confidences, and cases in falling order of their images."""
    tied = labelled_predictions(spark, sf).withColumns({"confidence": F.lit(1.0), "case_index": -F.col("image_id")})
    return ap_table(spark, sf, tied).select("implementation_id", "condition", "threshold", r6("ap"))


@query("evl_map", f"""WITH RECURSIVE {HOLDS_SQL}, {IOU_SQL}, {AP_SQL} SELECT implementation_id, condition, round(avg(ap), 6) AS map_all,
  round(max(CASE WHEN threshold = 0.5 THEN ap END), 6) AS ap50, round(max(CASE WHEN threshold = 0.75 THEN ap END), 6) AS ap75 FROM ap GROUP BY 1, 2""")
def _(spark, sf):
    report = d.map_report(ap_table(spark, sf))
    return report.select(
        "implementation_id", "condition", F.round("mAP", 6).alias("map_all"), F.round("AP50", 6).alias("ap50"), F.round("AP75", 6).alias("ap75")
    )


# ---- window idioms ---------------------------------------------------------------------------
RUN_SQL = f"""WITH {HOLDS_SQL}, s AS (SELECT event_type, hold_index, conf, CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END AS hit,
  row_number() OVER (PARTITION BY event_type ORDER BY conf DESC, image_id, hold_index) AS rank FROM p),
  c AS (SELECT *, sum(hit) OVER (PARTITION BY event_type ORDER BY rank) AS tp FROM s)"""


def _curve(spark, sf):
    order = [F.col("conf").desc(), F.col("image_id"), F.col("hold_index")]
    rows = labelled_predictions(spark, sf).select(
        "event_type", "image_id", "hold_index", F.col("confidence").alias("conf"), (F.col("k") % 3 == 0).cast("bigint").alias("hit")
    )
    chunks = chunked(rows, ["event_type"], order)
    return row_numbers(running_sum(chunks, ["event_type"], order, F.col("hit"), "tp"), ["event_type"], order, "rank")


@query("win_running_counts", RUN_SQL + " SELECT hold_index, rank, CAST(tp AS BIGINT) AS tp, CAST(rank - tp AS BIGINT) AS fp FROM c")
def _(spark, sf):
    return _curve(spark, sf).select("hold_index", "rank", "tp", (F.col("rank") - F.col("tp")).alias("fp"))


@query("win_envelope", RUN_SQL + """ SELECT hold_index, round(max(tp / CAST(rank AS DOUBLE)) OVER (PARTITION BY event_type ORDER BY rank
  ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 6) AS envelope FROM c""")
def _(spark, sf):
    from ..skew import suffix_max

    precision = F.col("tp") / F.col("rank")
    return suffix_max(_curve(spark, sf), ["event_type"], [F.col("rank")], precision, "envelope").select("hold_index", r6("envelope"))


@query("win_recall_steps", RUN_SQL + """, t AS (SELECT event_type, sum(hit) AS total FROM s GROUP BY 1),
  r AS (SELECT c.*, tp / CAST(total AS DOUBLE) AS recall FROM c JOIN t USING (event_type))
  SELECT hold_index, round(recall - coalesce(lag(recall) OVER (PARTITION BY event_type ORDER BY rank), 0), 9) AS step FROM r""")
def _(spark, sf):
    hit = (F.col("k") % 3 == 0).cast("bigint").alias("hit")
    curve = labelled_predictions(spark, sf).select("event_type", "hold_index", "confidence", "image_id", hit)
    totals = curve.groupBy("event_type").agg(F.sum("hit").alias("total"))
    order = [F.col("confidence").desc(), F.col("image_id"), F.col("hold_index")]
    counted = running_sum(chunked(curve, ["event_type"], order), ["event_type"], order, F.col("hit"), "tp")
    recall = counted.join(totals, "event_type").withColumn("recall", F.col("tp") / F.col("total"))
    steps = differences(recall, ["event_type"], order, F.col("recall"), "step")
    return steps.select("hold_index", F.round("step", 9).alias("step"))


@query("win_first_come", """SELECT image_id, label, dense_rank() OVER (PARTITION BY image_id ORDER BY first_hold) AS number FROM
  (SELECT user_id AS image_id, event_type AS label, min(event_id) AS first_hold FROM events GROUP BY 1, 2)""")
def _(spark, sf):
    firsts = w.holds(spark, sf).groupBy("image_id", F.col("event_type").alias("label")).agg(F.min("hold_index").alias("first_hold"))
    return ranked(firsts, ["image_id"], [F.col("first_hold")], "number").select("image_id", "label", "number")


@query("win_class_cap", """SELECT image_id, label, event_id AS hold_index FROM (SELECT *, row_number() OVER (PARTITION BY image_id, label ORDER BY md5(concat('7:', event_id)), event_id) AS n
  FROM (SELECT user_id AS image_id, event_type AS label, event_id FROM events)) WHERE n <= 5""")
def _(spark, sf):
    from pyspark.sql import Window

    lottery = F.md5(F.concat(F.lit("7:"), F.col("hold_index").cast("string")))
    order = Window.partitionBy("image_id", "label").orderBy("lot", "hold_index")
    rows = w.holds(spark, sf).select("image_id", F.col("event_type").alias("label"), "hold_index", lottery.alias("lot"))
    # A rank bound of a few rows is applied before the shuffle, so no class is held by one task.
    return rows.withColumn("n", F.row_number().over(order)).filter("n <= 5").select("image_id", "label", "hold_index")


# ---- order -----------------------------------------------------------------------------------
@query("ord_candidates", f"""WITH {HOLDS_SQL}, {IOU_SQL} SELECT image_id, pred_idx, ann_idx,
  row_number() OVER (PARTITION BY image_id ORDER BY iou DESC, pred_idx DESC, ann_idx DESC) AS position FROM iou WHERE iou >= 0.5""")
def _(spark, sf):
    order = [F.col("iou").desc(), F.col("pred_idx").desc(), F.col("ann_idx").desc()]
    return ranked(iou_table(spark, sf, 0.5), ["image_id"], order, "position").select("image_id", "pred_idx", "ann_idx", "position")


@query("ord_top_images", "SELECT user_id AS image_id, count(*) AS annotations FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def _(spark, sf):
    return top_images(w.holds(spark, sf), 10)


@query("ord_largest", f"""WITH {HOLDS_SQL} SELECT image_id, raw_label, hold_index, area FROM (SELECT *, row_number() OVER (PARTITION BY image_id, raw_label
  ORDER BY area DESC, hold_index) AS n FROM h) WHERE n = 1""")
def _(spark, sf):
    sized = w.holds(spark, sf).withColumn("area", (F.col("r") - F.col("l") + 1) * (F.col("b") - F.col("t") + 1))
    return largest_per_key(sized, ["image_id", "raw_label"], "area", "hold_index")


@query("ord_given", """SELECT doc_id AS image_id, row_number() OVER (ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) AS pos FROM documents
  WHERE doc_id % 2 = 0""")
def _(spark, sf):
    from ..sources.files import in_given_order

    docs = w.table(spark, sf, "documents").select(F.col("doc_id").alias("image_id"))
    wanted = docs.filter("image_id % 2 = 0").withColumn("lot", F.md5(F.col("image_id").cast("string")))
    order = ranked(wanted, [], [F.col("lot"), F.col("image_id")], "pos").select("image_id", "pos")
    return in_given_order(docs, order)


# ---- label transfer --------------------------------------------------------------------------
@query("join_transfer", f"""WITH RECURSIVE {HOLDS_SQL}, {IOU_SQL}, {MATCH_SQL} SELECT p.image_id, p.hold_index, coalesce(a.route_id, p.route_id) AS route_id
  FROM p LEFT JOIN m ON m.image_id = p.image_id AND m.pred_idx = p.hold_index LEFT JOIN a ON a.hold_index = m.ann_idx""")
def _(spark, sf):
    moved = transfer_labels(w.predictions(spark, sf), matches(spark, sf), w.annotations(spark, sf))
    return moved.select("image_id", "hold_index", "route_id")


@query("join_map_back", f"""WITH {HOLDS_SQL}, g AS (SELECT image_id, l, t, r, b, hold_index % 7 AS route_id FROM h WHERE hold_index % 3 > 0),
  s AS (SELECT image_id, l, t, r, b, max(hold_index) AS hold_index FROM h WHERE hold_index % 4 > 0 GROUP BY 1, 2, 3, 4, 5)
  SELECT image_id, hold_index, min(route_id) AS route_id FROM g JOIN s USING (image_id, l, t, r, b) GROUP BY 1, 2""")
def _(spark, sf):
    h = w.holds(spark, sf)
    grouped = h.filter("hold_index % 3 > 0").select("image_id", "polygon", (F.col("hold_index") % 7).alias("route_id"))
    return map_back(grouped, h.filter("hold_index % 4 > 0").select("image_id", "hold_index", "polygon"))


# ---- groupings against annotated routes ------------------------------------------------------
GROUPS_SQL = """g AS (SELECT image_id, hold_index, k % 4 AS pred, route_id AS truth FROM h WHERE role = 'annotation' AND hold_type IS NULL AND route_id IS NOT NULL),
cell AS (SELECT image_id, pred, truth, count(*) AS n FROM g GROUP BY 1, 2, 3),
mp AS (SELECT image_id, count(*) AS groups, sum(s * (s - 1) / 2.0) AS pairs, sum(big) AS big, sum(s * ln(s)) AS lg FROM (SELECT image_id, pred, sum(n) AS s, max(n) AS big FROM cell GROUP BY 1, 2) GROUP BY 1),
mt AS (SELECT image_id, count(*) AS groups, sum(s * (s - 1) / 2.0) AS pairs, sum(s * ln(s)) AS lg FROM (SELECT image_id, truth, sum(n) AS s FROM cell GROUP BY 1, 2) GROUP BY 1),
jt AS (SELECT image_id, sum(n) AS n, sum(n * (n - 1) / 2.0) AS same, sum(n * ln(n)) AS lg FROM cell GROUP BY 1),
q AS (SELECT jt.image_id, CAST(jt.n AS DOUBLE) AS n, CAST(same AS DOUBLE) AS same, CAST(mp.pairs AS DOUBLE) AS pp, CAST(mt.pairs AS DOUBLE) AS tp, mp.groups AS pg, mt.groups AS tg, mp.big,
  CASE WHEN mp.groups = 1 THEN 0 ELSE ln(jt.n) - mp.lg / jt.n END AS hp, CASE WHEN mt.groups = 1 THEN 0 ELSE ln(jt.n) - mt.lg / jt.n END AS ht,
  ln(jt.n) + (jt.lg - mp.lg - mt.lg) / jt.n AS mi FROM jt JOIN mp USING (image_id) JOIN mt USING (image_id)),
e AS (SELECT *, CASE WHEN n > 1 THEN pp * tp / (n * (n - 1) / 2) ELSE 0 END AS expd, (pp + tp) / 2 AS mx,
  CASE WHEN pp > 0 THEN same / pp WHEN tp > 0 THEN 0 ELSE 1 END AS prec, CASE WHEN tp > 0 THEN same / tp WHEN pp > 0 THEN 0 ELSE 1 END AS rec FROM q),
cm AS (SELECT image_id, CAST(n AS BIGINT) AS hold_count, pg AS predicted_route_count, tg AS ground_truth_route_count, prec AS pairwise_precision, rec AS pairwise_recall,
  CASE WHEN prec + rec > 0 THEN 2 * prec * rec / (prec + rec) ELSE 0 END AS pairwise_f1, big / n AS purity,
  CASE WHEN mx <> expd THEN (same - expd) / (mx - expd) ELSE 1 END AS adjusted_rand_index,
  CASE WHEN hp > 0 AND ht > 0 THEN mi / sqrt(hp * ht) WHEN hp = ht THEN 1 ELSE 0 END AS normalized_mutual_information FROM e)"""
METRIC_SQL = ", ".join(f"round({m}, 6) AS {m}" for m in rt.METRICS[3:])


def eligible(spark, sf):
    return w.annotations(spark, sf).filter(F.col("route_id").isNotNull())


def predicted_groups(spark, sf):
    return eligible(spark, sf).select("image_id", "hold_index", (F.col("k") % 4).alias("route_id"))


def cells(spark, sf):
    return rt.contingency(predicted_groups(spark, sf), eligible(spark, sf))


@query("evl_contingency", f"WITH {HOLDS_SQL}, {GROUPS_SQL} SELECT image_id, pred AS predicted, truth, n FROM cell")
def _(spark, sf):
    return cells(spark, sf)


@query("evl_clustering", f"""WITH {HOLDS_SQL}, {GROUPS_SQL} SELECT image_id, hold_count, predicted_route_count, ground_truth_route_count, {METRIC_SQL} FROM cm""")
def _(spark, sf):
    table = rt.clustering_metrics(cells(spark, sf))
    return table.select("image_id", *rt.METRICS[:3], *[r6(m) for m in rt.METRICS[3:]])


def route_report(spark, sf):
    return rt.evaluate_groupings(w.images(spark, sf), predicted_groups(spark, sf), eligible(spark, sf))


STATUS_SQL = """cs AS (SELECT CASE WHEN condition = 'clean' THEN 'clean' ELSE 'distorted' END AS condition, im.image_id, im.source_id, split,
  CASE WHEN cm.image_id IS NULL THEN 'unevaluable' ELSE 'evaluated' END AS status, cm.* EXCLUDE (image_id) FROM im LEFT JOIN cm ON cm.image_id = im.image_id)"""


@query("evl_conditions", f"""WITH {HOLDS_SQL}, {GROUPS_SQL}, {STATUS_SQL} SELECT condition, count(*) AS case_count, CAST(sum(CASE WHEN status = 'evaluated' THEN 1 ELSE 0 END) AS BIGINT) AS evaluated_case_count,
  CAST(sum(CASE WHEN status = 'unevaluable' THEN 1 ELSE 0 END) AS BIGINT) AS unevaluable_case_count, CAST(0 AS BIGINT) AS error_case_count,
  {', '.join(f'round(avg({m}), 6) AS {m}' for m in rt.METRICS)} FROM cs GROUP BY 1""")
def _(spark, sf):
    aggregates = route_report(spark, sf)[1]
    return aggregates.select(
        "condition", "case_count", "evaluated_case_count", "unevaluable_case_count", "error_case_count", *[r6(m) for m in rt.METRICS]
    )


@query("evl_status", f"""WITH {HOLDS_SQL}, pc AS (SELECT event_type AS implementation_id, image_id, count(*) AS np, CAST(sum(CASE WHEN confidence IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS nf FROM p GROUP BY 1, 2),
  ac AS (SELECT image_id, count(*) AS na FROM a GROUP BY 1)
  SELECT s.implementation_id, im.image_id, CASE WHEN condition = 'clean' THEN 'clean' ELSE 'distorted' END AS condition, CASE WHEN coalesce(na, 0) > 0 THEN 'evaluated' ELSE 'unevaluable' END AS status,
  coalesce(np, 0) AS prediction_count, coalesce(na, 0) AS ground_truth_count, coalesce(np - nf, 0) AS confidence_attribute_count, coalesce(nf, 0) AS confidence_fallback_count
  FROM im CROSS JOIN (VALUES ('view'), ('click')) AS s(implementation_id) LEFT JOIN pc ON pc.image_id = im.image_id AND pc.implementation_id = s.implementation_id LEFT JOIN ac ON ac.image_id = im.image_id""")
def _(spark, sf):
    cases = d.detection_cases(w.images(spark, sf), labelled_predictions(spark, sf), truth_rows(spark, sf), DETECTORS)
    return cases.select(
        "implementation_id", "image_id", "condition", "status", "prediction_count", "ground_truth_count",
        "confidence_attribute_count", "confidence_fallback_count",
    )


@query("evl_error_cases", f"""WITH {HOLDS_SQL}, bad AS (SELECT DISTINCT event_type, image_id FROM p WHERE hold_index % 50 = 0)
  SELECT s.implementation_id, CASE WHEN bad.image_id IS NOT NULL THEN 'error' WHEN im.image_id IN (SELECT image_id FROM a) THEN 'evaluated' ELSE 'unevaluable' END AS status,
  CASE WHEN bad.image_id IS NOT NULL THEN 'polygon' END AS error, count(*) AS n FROM im CROSS JOIN (VALUES ('view'), ('click')) AS s(implementation_id)
  LEFT JOIN bad ON bad.image_id = im.image_id AND bad.event_type = s.implementation_id GROUP BY 1, 2, 3""")
def _(spark, sf):
    broken = F.slice("polygon", F.lit(1), F.when(F.col("hold_index") % 50 == 0, 2).otherwise(4))
    ok, rejected = validate_holds(labelled_predictions(spark, sf).withColumn("polygon", broken))
    cases = d.detection_cases(w.images(spark, sf), ok, truth_rows(spark, sf), DETECTORS, rejected)
    return cases.groupBy("implementation_id", "status", "error").agg(F.count(F.lit(1)).alias("n"))


@query("evl_summary", f"""WITH {HOLDS_SQL}, {GROUPS_SQL}, {STATUS_SQL}, u AS (UNPIVOT (SELECT {', '.join(f'CAST({m} AS DOUBLE) AS {m}' for m in rt.METRICS)} FROM cs WHERE status = 'evaluated')
  ON {', '.join(rt.METRICS)} INTO NAME metric VALUE value)
  SELECT metric, round(avg(value), 6) AS value FROM u GROUP BY 1 UNION ALL SELECT 'case_count', count(*) FROM cs UNION ALL
  SELECT 'evaluated_case_count', count(*) FROM cs WHERE status = 'evaluated' UNION ALL SELECT 'unevaluable_case_count', count(*) FROM cs WHERE status = 'unevaluable'
  UNION ALL SELECT 'error_case_count', 0""")
def _(spark, sf):
    return rep.summarize_cases(route_report(spark, sf)[0], rt.METRICS).select("metric", r6("value"))


@query("snk_metric_rows", f"""WITH {HOLDS_SQL}, {GROUPS_SQL}, {STATUS_SQL},
  ag AS (SELECT condition, CAST(count(*) AS DOUBLE) AS case_count, avg(purity) AS purity FROM cs GROUP BY 1),
  rows1 AS (UNPIVOT (SELECT condition, CAST(image_id AS VARCHAR) AS case_id, image_id, source_id, split, status, purity, pairwise_f1 FROM cs) ON purity, pairwise_f1 INTO NAME metric VALUE value),
  rows2 AS (UNPIVOT (SELECT condition, CAST(NULL AS VARCHAR) AS case_id, CAST(NULL AS BIGINT) AS image_id, CAST(NULL AS BIGINT) AS source_id, CAST(NULL AS VARCHAR) AS split, 'aggregate' AS status, case_count, purity FROM ag) ON case_count, purity INTO NAME metric VALUE value)
  SELECT 'run' AS run_id, 'route_discrimination' AS target, * REPLACE (round(value, 6) AS value) FROM (SELECT * FROM rows1 UNION ALL BY NAME SELECT * FROM rows2)""")
def _(spark, sf):
    cases, aggregates = route_report(spark, sf)
    rows = rep.metric_rows(
        cases.withColumn("case_id", F.col("case_id").cast("string")), aggregates, run_id="run", target="route_discrimination",
        case_metrics=["purity", "pairwise_f1"], aggregate_metrics=["case_count", "purity"],
    )
    return rows.withColumn("value", F.round("value", 6))


@query("snk_report_json", f"""WITH {HOLDS_SQL}, {GROUPS_SQL}, {STATUS_SQL} SELECT condition, count(*) AS case_count, round(avg(purity), 6) AS purity, round(avg(hold_count), 6) AS hold_count FROM cs GROUP BY 1""")
def _(spark, sf):
    # The report text is parsed again, so that its content is what gets compared.
    schema = "condition string, case_count bigint, purity double, hold_count double"
    texts = rep.report_json(route_report(spark, sf)[1])
    return texts.select(F.from_json("json", schema).alias("j")).select("j.condition", "j.case_count", r6("j.purity").alias("purity"), r6("j.hold_count").alias("hold_count"))


@query("join_clean_distorted", f"""WITH {HOLDS_SQL}, {GROUPS_SQL}, {STATUS_SQL} SELECT d.source_id, d.image_id, round(d.purity - c.purity, 6) AS delta
  FROM cs d JOIN cs c ON c.source_id = d.source_id AND c.condition = 'clean' WHERE d.condition = 'distorted' AND d.purity IS NOT NULL AND c.purity IS NOT NULL""")
def _(spark, sf):
    return rep.clean_vs_distorted(route_report(spark, sf)[0], ["purity"]).select("source_id", "image_id", r6("delta"))


ROUTE_SQL = f"""{MATCH_SQL}, pr AS (SELECT event_type AS detector, image_id, hold_index, k % 4 AS route FROM p), tr AS (SELECT image_id, hold_index, route_id AS route FROM a WHERE route_id IS NOT NULL),
  mapped AS (SELECT pr.detector, pr.image_id, pr.route, m.ann_idx FROM pr JOIN m ON m.image_id = pr.image_id AND m.pred_idx = pr.hold_index AND m.implementation_id = pr.detector),
  sp AS (SELECT detector, image_id, route, count(*) AS n FROM mapped GROUP BY 1, 2, 3), st AS (SELECT image_id, route, count(*) AS n FROM tr GROUP BY 1, 2),
  dice AS (SELECT x.detector, x.image_id, x.pr AS pred_route, x.tr AS ann_route, 2.0 * x.n / CAST(sp.n + st.n AS DOUBLE) AS dice FROM
    (SELECT mapped.detector, mapped.image_id, mapped.route AS pr, tr.route AS tr, count(*) AS n FROM mapped JOIN tr ON tr.image_id = mapped.image_id AND tr.hold_index = mapped.ann_idx GROUP BY 1, 2, 3, 4) x
    JOIN sp ON sp.detector = x.detector AND sp.image_id = x.image_id AND sp.route = x.pr JOIN st ON st.image_id = x.image_id AND st.route = x.tr)"""


def detector_routes(spark, sf):
    """(predictions with routes, matches) whose indices restart for every detector and image."""
    place = Window.partitionBy("event_type", "image_id").orderBy("hold_index")
    held = w.predictions(spark, sf).withColumn("place", (F.row_number().over(place) - 1).cast("bigint"))
    named = held.select(F.col("event_type").alias("implementation_id"), "image_id", "hold_index", "place", (F.col("k") % 4).alias("route_id"))
    found = matches(spark, sf).withColumnRenamed("pred_idx", "hold_index").join(named, ["implementation_id", "image_id", "hold_index"])
    return (
        named.select(F.col("implementation_id").alias("detector"), "image_id", F.col("place").alias("hold_index"), "route_id"),
        found.select(F.col("implementation_id").alias("detector"), "image_id", F.col("place").alias("pred_idx"), "ann_idx"),
    )


@query("evl_route_candidates", f"WITH RECURSIVE {HOLDS_SQL}, {IOU_SQL}, {ROUTE_SQL} SELECT detector, image_id, pred_route, ann_route, round(dice, 6) AS dice FROM dice")
def _(spark, sf):
    truth = eligible(spark, sf).select("image_id", "hold_index", "route_id")
    predicted, found = detector_routes(spark, sf)
    return rt.route_candidates(predicted, truth, found, ["detector"]).select("detector", "image_id", "pred_route", "ann_route", r6("dice"))


@query("evl_route_match", f"""WITH RECURSIVE {HOLDS_SQL}, {IOU_SQL}, {ROUTE_SQL},
  rc AS (SELECT *, row_number() OVER (PARTITION BY detector, image_id ORDER BY dice DESC, pred_route DESC, ann_route DESC) AS n FROM dice),
  rw AS (SELECT detector, image_id, 0::BIGINT AS n, CAST([] AS BIGINT[]) AS up, CAST([] AS BIGINT[]) AS ua, false AS hit FROM (SELECT DISTINCT detector, image_id FROM rc)
    UNION ALL SELECT rw.detector, rw.image_id, c.n, CASE WHEN list_contains(rw.up, c.pred_route) OR list_contains(rw.ua, c.ann_route) THEN rw.up ELSE list_append(rw.up, c.pred_route) END,
    CASE WHEN list_contains(rw.up, c.pred_route) OR list_contains(rw.ua, c.ann_route) THEN rw.ua ELSE list_append(rw.ua, c.ann_route) END,
    NOT (list_contains(rw.up, c.pred_route) OR list_contains(rw.ua, c.ann_route)) FROM rw JOIN rc c ON c.detector = rw.detector AND c.image_id = rw.image_id AND c.n = rw.n + 1),
  rm AS (SELECT c.detector, c.image_id, count(*) AS n, avg(dice) AS mean FROM rw JOIN rc c ON c.detector = rw.detector AND c.image_id = rw.image_id AND c.n = rw.n WHERE rw.hit GROUP BY 1, 2),
  np AS (SELECT detector, image_id, count(DISTINCT route) AS n FROM pr GROUP BY 1, 2), nt AS (SELECT image_id, count(DISTINCT route) AS n FROM tr GROUP BY 1),
  ca AS (SELECT im.image_id, d.detector FROM im, (VALUES ('view'), ('click')) AS d(detector))
  SELECT ca.detector, ca.image_id, coalesce(rm.n, 0) AS matched_routes, coalesce(np.n, 0) AS predicted_routes, coalesce(nt.n, 0) AS annotated_routes,
  round(coalesce(rm.n / CAST(np.n AS DOUBLE), 0), 6) AS precision, round(coalesce(rm.n / CAST(nt.n AS DOUBLE), 0), 6) AS recall,
  round(coalesce(2.0 * rm.n / CAST(np.n + nt.n AS DOUBLE), 0), 6) AS f1, round(coalesce(rm.mean, 0), 6) AS mean_matched_route_f1
  FROM ca LEFT JOIN rm USING (detector, image_id) LEFT JOIN np USING (detector, image_id) LEFT JOIN nt USING (image_id)""")
def _(spark, sf):
    truth = eligible(spark, sf).select("image_id", "hold_index", "route_id")
    predicted, found = detector_routes(spark, sf)
    table = rt.route_match_metrics(w.images(spark, sf), predicted, truth, found, {"detector": ("view", "click")})
    return table.select(
        "detector", "image_id", "matched_routes", "predicted_routes", "annotated_routes", r6("precision"), r6("recall"), r6("f1"), r6("mean_matched_route_f1")
    )


@query("evl_pair_metrics", """SELECT event_type, round(avg(greatest(z, 0) - z * y + ln(1 + exp(-abs(z)))), 6) AS loss,
  round(avg(CASE WHEN (z >= 0) = (y = 1) THEN 1.0 ELSE 0.0 END), 6) AS accuracy,
  round(2 * sum(CASE WHEN z >= 0 AND y = 1 THEN 1 ELSE 0 END) / CAST(sum(CASE WHEN z >= 0 AND y = 1 THEN 2 WHEN z >= 0 OR y = 1 THEN 1 ELSE 0 END) AS DOUBLE), 6) AS f1
  FROM (SELECT event_type, value / 50 - 1 AS z, event_id % 2 AS y FROM events) GROUP BY 1""")
def _(spark, sf):
    scored = w.table(spark, sf, "events").selectExpr("event_type", "value / 50 - 1 AS logit", "event_id % 2 AS label")
    return rt.pair_metrics(scored, ["event_type"]).select("event_type", r6("loss"), r6("accuracy"), r6("f1"))


@query("evl_result_counts", f"WITH {HOLDS_SQL} SELECT image_id, count(*) AS hold_count, count(DISTINCT route_id) AS route_count FROM h WHERE route_id IS NOT NULL GROUP BY 1")
def _(spark, sf):
    return rt.result_counts(w.holds(spark, sf).filter(F.col("route_id").isNotNull()))


# ---- whole runs ------------------------------------------------------------------------------
@query("run_detections", f"""WITH RECURSIVE {HOLDS_SQL}, {IOU_SQL}, {AP_SQL}, pc AS (SELECT event_type AS implementation_id, condition, count(*) AS np FROM p JOIN cond USING (image_id)
  WHERE image_id IN (SELECT image_id FROM a) GROUP BY 1, 2), cc AS (SELECT condition, count(*) AS n, CAST(sum(CASE WHEN image_id IN (SELECT image_id FROM a) THEN 1 ELSE 0 END) AS BIGINT) AS ev FROM cond GROUP BY 1)
  SELECT implementation_id, condition, cc.n AS case_count, cc.ev AS evaluated_case_count, pc.np AS prediction_count, truths.truths AS ground_truth_count, round(x.m, 6) AS map_all
  FROM (SELECT implementation_id, condition, avg(ap) AS m FROM ap GROUP BY 1, 2) x JOIN pc USING (implementation_id, condition) JOIN cc USING (condition) JOIN truths USING (condition)""")
def _(spark, sf):
    _, aggregates = d.evaluate_detections(
        w.images(spark, sf), labelled_predictions(spark, sf), truth_rows(spark, sf), iou_table(spark, sf, 0.5), DETECTORS
    )
    return aggregates.select(
        "implementation_id", "condition", "case_count", "evaluated_case_count", "prediction_count", "ground_truth_count", F.round("mAP", 6).alias("map_all")
    )


@query("evl_match_chain", """SELECT CAST(floor(event_id / 50000) AS BIGINT) AS image_id, event_id // 2 AS pred_idx, event_id // 2 AS ann_idx FROM events WHERE event_id % 2 = 0""")
def _(spark, sf):
    """Events as one falling chain per 50,000: each edge shares an end with the next, and only even ones can be taken."""
    event = F.col("event_id")
    chain = w.table(spark, sf, "events").select(
        F.floor(event / 50000).cast("bigint").alias("image_id"),
        F.floor((event + 1) / 2).cast("bigint").alias("pred_idx"),
        F.floor(event / 2).cast("bigint").alias("ann_idx"),
        (F.lit(1.0) - (event % 50000) / 100000.0).alias("iou"),
    )
    return match_greedy(chain, 0.25).select("image_id", "pred_idx", "ann_idx")
