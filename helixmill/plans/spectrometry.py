"""Queries over derived spectra and masses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixmill.operators import spectra as P
from helixmill.plans.registry import long, query, rounded
from helixmill.sources import fixtures as X

SP = X.SPECTRA
PEAKS = SP + """,
peaks AS (SELECT * EXCLUDE (m), greatest(idx - 2, 0) AS "left", least(idx + 2, n - 1) AS "right" FROM (SELECT *, max(y) OVER (PARTITION BY spectrum_id ORDER BY idx ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS m, count(*) OVER (PARTITION BY spectrum_id) AS n FROM spectra) WHERE y = m)"""
MS = "," + X.MASSES


def _spectra(spark, d) -> DataFrame:
    return X.spectra(spark, d)


def _peaks(spark, d) -> DataFrame:
    s = X.spectra(spark, d)
    n = F.count("*").over(P.Window.partitionBy("spectrum_id"))
    p = P.local_maxima(s.withColumn("n", n))
    return p.withColumn("left", F.greatest(F.col("idx") - 2, F.lit(0))).withColumn("right", F.least(F.col("idx") + 2, F.col("n") - 1)).drop("n")


def _masses(spark, d) -> DataFrame:
    return X.expected_masses(spark, d)


@query("sp1_smooth", SP, "SELECT spectrum_id, idx, round(y, 4) AS y FROM (SELECT spectrum_id, idx, sum(y) OVER (PARTITION BY spectrum_id ORDER BY idx ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING) / 5 AS y, count(*) OVER (PARTITION BY spectrum_id) AS n FROM spectra) WHERE idx >= 3 AND idx < n - 4")
def sp1(spark, d):
    return rounded(P.smooth(_spectra(spark, d), 3).select("spectrum_id", "idx", "y"), "y")


@query("sp2_blank_subtraction", SP, "SELECT s.spectrum_id, s.idx, round(s.y - b.y, 4) AS y FROM spectra s JOIN spectra b ON b.spectrum_id = 0 AND b.idx = s.idx WHERE s.spectrum_id <> 0")
def sp2(spark, d):
    s = _spectra(spark, d)
    return rounded(P.subtract(s.where("spectrum_id <> 0"), s.where("spectrum_id = 0")).select("spectrum_id", "idx", "y"), "y")


@query("sp3_baseline", SP, "SELECT spectrum_id, round(stddev_samp(y), 4) AS sd, round(3 * stddev_samp(y), 4) AS lod, round(10 * stddev_samp(y), 4) AS loq FROM spectra WHERE (x > 1000 AND x < 2001) OR (x > 5000 AND x < 6001) GROUP BY spectrum_id")
def sp3(spark, d):
    return rounded(P.baseline(_spectra(spark, d), [(1000.0, 2000.0), (5000.0, 6000.0)]), "sd", "lod", "loq")


@query("sp4_statistics", SP, "SELECT spectrum_id, idx, round((y - avg(y) OVER w) / stddev_samp(y) OVER w, 4) AS z FROM spectra WINDOW w AS (PARTITION BY spectrum_id)")
def sp4(spark, d):
    return rounded(P.statistics(_spectra(spark, d)).select("spectrum_id", "idx", "z"), "z")


@query("sp5_peak_recognition")
def sp5(spark, d):
    return P.recognize_peaks(_spectra(spark, d), min_x=1000.0, min_height=5.0, step=20.0).select("spectrum_id", "idx", "x", "y")


@query("sp6_confirmed_peaks", PEAKS + MS, "SELECT p.spectrum_id, p.idx FROM peaks p WHERE EXISTS (SELECT 1 FROM masses m WHERE abs(p.x - m.mass) <= 1.0) AND EXISTS (SELECT 1 FROM peaks z WHERE z.timepoint = 0 AND abs(p.x - z.x) < (p.x + z.x) / 10000)")
def sp6(spark, d):
    p = _peaks(spark, d)
    return P.confirmed_peaks(p, _masses(spark, d), 1.0, p.where("timepoint = 0")).select("spectrum_id", "idx")


@query("sp7_bracketing_troughs")
def sp7(spark, d):
    return P.recognize_peaks(_spectra(spark, d), step=20.0, bounds="troughs").select("spectrum_id", "idx", "left", "right")


@query("sp8_peak_bounds")
def sp8(spark, d):
    s = _spectra(spark, d)
    slope = P.recognize_peaks(s, step=20.0).withColumn("style", F.lit("slope"))
    return slope.unionByName(P.recognize_peaks(s, step=20.0, style="minrange").withColumn("style", F.lit("minrange"))).select("spectrum_id", "style", "idx", "left", "right")


@query("sp9_peak_area", PEAKS, 'SELECT p.spectrum_id, p.idx, round(sum(s.y), 3) AS area FROM peaks p JOIN spectra s ON s.spectrum_id = p.spectrum_id AND s.idx BETWEEN p."left" AND p."right" GROUP BY ALL')
def sp9(spark, d):
    return rounded(P.peak_areas(_spectra(spark, d), _peaks(spark, d)).select("spectrum_id", "idx", "area"), "area", digits=3)


@query("sp10_area_of_ranges", SP, """
, i AS (SELECT spectrum_id, min(idx) AS lo, max(idx) AS hi, arg_min(y, idx) AS y0, arg_max(y, idx) AS y1 FROM spectra WHERE x > 2000 AND x < 3000 GROUP BY 1)
SELECT s.spectrum_id, round(sum(y - CASE WHEN y0 > 0 AND y1 > 0 AND y0 < y1 THEN y0 ELSE 0 END), 3) AS area FROM spectra s JOIN i USING (spectrum_id) WHERE idx >= lo AND idx < hi GROUP BY 1""")
def sp10(spark, d):
    return rounded(P.area_of_ranges(_spectra(spark, d), [(2000.0, 3000.0)]), "area", digits=3)


@query("sp11_interpolation", SP, """
, e AS (SELECT max(lo) AS lo, min(hi) AS hi FROM (SELECT min(x) AS lo, max(x) AS hi FROM spectra GROUP BY spectrum_id)),
ax AS (SELECT x FROM spectra, e WHERE spectrum_id = 0 AND x BETWEEN lo AND hi),
q AS (SELECT s.spectrum_id, a.x, max(CASE WHEN s.x <= a.x THEN s.x END) AS xa, min(CASE WHEN s.x >= a.x THEN s.x END) AS xb FROM ax a, spectra s GROUP BY ALL),
r AS (SELECT q.spectrum_id, q.x, xa, xb, arg_max(a.y, a.idx) AS ya, arg_min(b.y, b.idx) AS yb FROM q JOIN spectra a ON a.spectrum_id = q.spectrum_id AND a.x = xa JOIN spectra b ON b.spectrum_id = q.spectrum_id AND b.x = xb GROUP BY ALL)
SELECT spectrum_id, round(x, 4) AS x, round(CASE WHEN xb > xa THEN ya + (x - xa) / (xb - xa) * (yb - ya) ELSE ya END, 4) AS y FROM r""")
def sp11(spark, d):
    s = _spectra(spark, d)
    return rounded(P.interpolate(s, s.where("spectrum_id = 0")).select("spectrum_id", "x", "y"), "x", "y")


@query("sp12_pointwise", SP, "SELECT timepoint, idx, greatest(max(y), 0) AS y_max, round(avg(y), 4) AS y_mean FROM spectra GROUP BY ALL")
def sp12(spark, d):
    return rounded(P.pointwise(_spectra(spark, d), ["timepoint"]), "y_mean")


@query("sp13_subtraction", SP, "SELECT s.idx, round(s.y - b.y, 4) AS y FROM spectra s JOIN spectra b ON s.idx = b.idx WHERE s.spectrum_id = 7 AND b.spectrum_id = 3")
def sp13(spark, d):
    s = _spectra(spark, d)
    return rounded(P.subtract(s.where("spectrum_id = 7"), s.where("spectrum_id = 3")).select("idx", "y"), "y")


@query("sp14_scaled_control", PEAKS, """
, c AS (SELECT idx, y FROM spectra WHERE spectrum_id = 0), cp AS (SELECT idx, y FROM peaks WHERE spectrum_id = 0 AND y > 0),
r AS (SELECT s.spectrum_id, min(CASE WHEN s.y / cp.y < 1 THEN s.y / cp.y END) AS ratio FROM spectra s JOIN cp USING (idx) WHERE s.spectrum_id <> 0 GROUP BY 1)
SELECT s.spectrum_id, s.idx, round(s.y - coalesce(ratio, 0) * c.y, 4) AS y FROM spectra s JOIN c USING (idx) LEFT JOIN r USING (spectrum_id) WHERE s.spectrum_id <> 0""")
def sp14(spark, d):
    s = _spectra(spark, d)
    out = P.subtract_scaled_control(s.where("spectrum_id <> 0"), s.where("spectrum_id = 0"), _peaks(spark, d).where("spectrum_id = 0"))
    return rounded(out.select("spectrum_id", "idx", "y"), "y")


CONS = PEAKS + """,
base AS (SELECT idx AS peak, x AS peak_x FROM peaks WHERE spectrum_id = 0),
hit AS (SELECT peak, spectrum_id, idx, x, y, row_number() OVER (PARTITION BY peak, spectrum_id ORDER BY abs(x - peak_x), idx) AS k FROM base JOIN peaks ON abs(x - peak_x) <= 120.0),
agreed AS (SELECT peak, spectrum_id, idx, x, y FROM hit WHERE k = 1 AND peak IN (SELECT peak FROM hit WHERE k = 1 GROUP BY peak HAVING count(*) >= 0.6 * (SELECT count(DISTINCT spectrum_id) FROM peaks)))"""


def _agreed(spark, d) -> DataFrame:
    """Peaks of the first spectrum that three in five spectra have."""
    return P.consensus(_peaks(spark, d), 120.0, share=0.6)


@query("sp15_consensus_peaks", CONS, "SELECT peak, spectrum_id, idx FROM agreed")
def sp15(spark, d):
    return _agreed(spark, d).select("peak", "spectrum_id", "idx")


@query("sp16_scale_by_ratio", CONS, """
, r AS (SELECT a.spectrum_id, avg(b.y / a.y) AS ratio FROM agreed a JOIN agreed b ON b.spectrum_id = 0 AND a.peak = b.peak WHERE a.y <> 0 GROUP BY 1)
SELECT spectrum_id, idx, round(y * ratio, 3) AS y FROM spectra JOIN r USING (spectrum_id)""")
def sp16(spark, d):
    return rounded(P.scale_by_ratio(_spectra(spark, d), _agreed(spark, d)).select("spectrum_id", "idx", "y"), "y", digits=3)


@query("sp17_scale_by_sum", CONS, """
, t AS (SELECT spectrum_id, sum(y) AS total FROM agreed GROUP BY 1), z AS (SELECT peak, y, y * (SELECT max(total) FROM t) / total AS s FROM agreed JOIN t USING (spectrum_id))
SELECT peak, round(avg(y), 1) AS mean_before, round(stddev_samp(y), 1) AS sd_before, round(stddev_samp(y) / avg(y), 1) AS cv_before, round(avg(s), 1) AS mean_after, round(stddev_samp(s), 1) AS sd_after, round(stddev_samp(s) / avg(s), 1) AS cv_after FROM z GROUP BY peak""")
def sp17(spark, d):
    return rounded(P.scale_by_sum(_agreed(spark, d)), "mean_before", "sd_before", "cv_before", "mean_after", "sd_after", "cv_after", digits=1)


NEAREST = PEAKS + MS + """,
near AS (SELECT * FROM (SELECT p.spectrum_id, p.idx, p.x, p.y, m.fragment_id, m.mass, m.mass - p.x AS off, row_number() OVER (PARTITION BY p.spectrum_id, p.idx ORDER BY abs(p.x - m.mass), m.fragment_id) AS k FROM peaks p JOIN masses m ON abs(p.x - m.mass) < 0.0005 * m.mass) WHERE k = 1)"""


def _near(spark, d) -> DataFrame:
    return P.nearest_mass(_peaks(spark, d), _masses(spark, d), 0.0005)


@query("sp18_nearest_fragment", NEAREST, "SELECT spectrum_id, idx, fragment_id, round(off, 4) AS off FROM near")
def sp18(spark, d):
    return rounded(_near(spark, d).select("spectrum_id", "idx", "fragment_id", "off"), "off")


@query("sp18m_shared_fragments", NEAREST, """
, b AS (SELECT fragment_id % 6 AS fragment_id, spectrum_id, y FROM near)
SELECT fragment_id, spectrum_id, max(y) AS height FROM b WHERE fragment_id IN (SELECT fragment_id FROM b GROUP BY 1 HAVING count(DISTINCT spectrum_id) = (SELECT count(DISTINCT spectrum_id) FROM b)) GROUP BY ALL""")
def sp18m(spark, d):
    return P.shared_fragments(_near(spark, d).withColumn("fragment_id", F.expr("fragment_id % 6")))


@query("sp19_calibration_clusters", PEAKS + MS, """
, f AS (SELECT DISTINCT spectrum_id, off AS try FROM (SELECT p.spectrum_id, m.mass - p.x AS off, row_number() OVER (PARTITION BY p.spectrum_id, p.idx ORDER BY abs(p.x - m.mass), m.fragment_id) AS k FROM peaks p JOIN masses m ON abs(p.x - m.mass) < 0.0015 * m.mass WHERE p.y >= 1) WHERE k = 1),
g AS (SELECT spectrum_id, try, idx, x, mass FROM (SELECT p.spectrum_id, f.try, p.idx, p.x, m.mass, row_number() OVER (PARTITION BY p.spectrum_id, f.try, p.idx ORDER BY abs(p.x + f.try - m.mass), m.fragment_id) AS k FROM peaks p JOIN f ON p.spectrum_id = f.spectrum_id JOIN masses m ON abs(p.x + f.try - m.mass) < 0.0002 * m.mass WHERE p.y >= 1) WHERE k = 1),
n AS (SELECT spectrum_id, try, count(*) AS n, avg(mass - x) AS shift FROM g GROUP BY ALL)
SELECT spectrum_id, round(shift, 4) AS shift, n FROM (SELECT *, row_number() OVER (PARTITION BY spectrum_id ORDER BY n DESC, abs(try), try) AS k FROM n) WHERE k = 1""")
def sp19(spark, d):
    return rounded(P.calibrate_by_clustering(_peaks(spark, d), _masses(spark, d), resolution=0.001), "shift")


@query("sp20_calibration_offset", NEAREST, "SELECT spectrum_id, round(avg(off), 4) AS shift, count(*) AS n FROM near WHERE y >= 3 GROUP BY 1")
def sp20(spark, d):
    return rounded(P.calibrate_by_mean(_peaks(spark, d), _masses(spark, d), 0.0005), "shift")


@query("sp21_rescale", SP, "SELECT spectrum_id, idx, round(y * 42.5 / 100, 6) AS y FROM spectra")
def sp21(spark, d):
    return rounded(_spectra(spark, d).select("spectrum_id", "idx", (F.col("y") * 42.5 / 100).alias("y")), "y", digits=6)


MODEL = PEAKS + """,
model AS (SELECT s.spectrum_id, s.idx, any_value(s.x) AS x, any_value(s.y) AS y, coalesce(sum((0.54 * p.y + p.y * p.x / 223.6) / (sqrt(2 * pi()) * (p.x / 476)) * exp(-(((s.x - p.x) / (p.x / 476))**2) / 2)), 0) AS model
  FROM spectra s LEFT JOIN peaks p ON s.spectrum_id = p.spectrum_id AND abs(s.x - p.x) < 0.12 * p.x GROUP BY ALL)"""


def _model(spark, d) -> DataFrame:
    return P.modelled(_spectra(spark, d), _peaks(spark, d))


@query("sp22_modelled_curve", MODEL, "SELECT spectrum_id, idx, round(model, 3) AS model FROM model")
def sp22(spark, d):
    return rounded(_model(spark, d).select("spectrum_id", "idx", "model"), "model", digits=3)


@query("sp22r_model_residual", MODEL, "SELECT spectrum_id, round(sqrt(avg((y - model)**2)), 3) AS rms FROM model GROUP BY 1")
def sp22r(spark, d):
    return rounded(P.model_residual(_model(spark, d)), "rms", digits=3)


def _shape_sql(name: str, height: str) -> str:
    return f"""{name} AS (SELECT s.spectrum_id, s.idx, any_value(s.y) AS y, coalesce(sum({height}), 0) AS model
  FROM spectra s LEFT JOIN tops p ON s.spectrum_id = p.spectrum_id AND abs(s.x - p.x) < 0.12 * p.x GROUP BY ALL)"""


_BELL = "({h}) / (sqrt(2 * pi()) * ({w})) * exp(-(((s.x - p.x) / ({w}))**2) / 2)"
SHAPED = PEAKS + """,
tops AS (SELECT peaks.*, max_x FROM peaks JOIN (SELECT spectrum_id, max(x) AS max_x FROM spectra GROUP BY 1) USING (spectrum_id)),
""" + ",\n".join((
    _shape_sql("gaussian", _BELL.format(w="p.x / 476", h="0.54 * p.y + p.y * p.x / 223.6")),
    _shape_sql("cauchy", "CASE WHEN p.y <> 0 THEN power(abs(1 / (0.05 * p.y)), 3) / (pi() * (power(abs(0.27 / (0.05 * p.y)), 6.56) + power(abs(s.x - p.x), 1.97))) ELSE 0 END"),
    _shape_sql("doubled", _BELL.format(w="p.x / 787.58", h="5.01 * p.y + p.y * power(p.x, 1 - 0.1 * p.x / max_x) / 822.81") + " + " + _BELL.format(w="p.x / 152.29", h="-12.49 * p.y + p.y * power(p.x, 1 + 0.1 * p.x / max_x) / 249.53")),
))


@query("sp22s_shape_residuals", SHAPED, "SELECT shape, spectrum_id, round(sqrt(avg((y - model)**2)), 3) AS rms FROM (" + " UNION ALL ".join(f"SELECT '{n}' AS shape, * FROM {t}" for n, t in (("gaussian", "gaussian"), ("cauchy", "cauchy"), ("double gaussian", "doubled"))) + ") GROUP BY ALL")
def sp22s(spark, d):
    """How far each shape's first approximation is from the spectra."""
    out = [P.model_residual(P.modelled(_spectra(spark, d), _peaks(spark, d), shape)).withColumn("shape", F.lit(shape)) for shape in P.SHAPES]
    return rounded(out[0].unionByName(out[1]).unionByName(out[2]), "rms", digits=3)


@query("sp23s_fitted_shapes")
def sp23s(spark, d):
    """Parameters of double gaussian peaks, region by region."""
    s, p = _spectra(spark, d), _peaks(spark, d)
    return P.fit_shapes(P.modelled(s, p, "double gaussian"), p, "double gaussian").select("spectrum_id", "idx", F.transform("parameters", lambda v: F.round(v, 3)).alias("parameters"), F.round("rms", 3).alias("rms"))


@query("sp23_fitted_heights")
def sp23(spark, d):
    return rounded(P.fit_heights(_model(spark, d), _peaks(spark, d)), "height", digits=3)


@query("sp24_apex_tracking", CONS, """
, c AS (SELECT DISTINCT peak FROM agreed), w AS (SELECT s.spectrum_id, c.peak, s.idx - c.peak AS d, s.idx, s.y FROM spectra s JOIN c ON abs(s.idx - c.peak) <= 8),
m AS (SELECT *, greatest(max(CASE WHEN d = 0 THEN y END) OVER (PARTITION BY spectrum_id, peak), max(y) OVER (PARTITION BY spectrum_id, peak, sign(d) ORDER BY abs(d))) AS top FROM w),
t AS (SELECT *, max(CASE WHEN top - y >= 60 THEN 1 ELSE 0 END) OVER (PARTITION BY spectrum_id, peak, sign(d) ORDER BY abs(d)) AS stop FROM m),
a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY spectrum_id, peak ORDER BY y DESC, abs(d), d DESC) AS k FROM t WHERE d = 0 OR stop = 0) WHERE k = 1)
SELECT spectrum_id, peak, idx AS apex, abs(d) = 8 AS at_border, count(*) OVER (PARTITION BY spectrum_id, idx) > 1 AS shared FROM a""")
def sp24(spark, d):
    return P.track_apexes(_spectra(spark, d), _agreed(spark, d).select(F.col("peak").alias("idx")).distinct(), step=60.0)


def _assoc_sql(name: str, added: float) -> str:
    return f"{name} AS (SELECT * FROM (SELECT p.spectrum_id, p.idx, p.x, p.y, m.fragment_id, row_number() OVER (PARTITION BY p.spectrum_id, m.fragment_id ORDER BY abs(p.x - (m.mass + {added})), p.idx) AS k FROM peaks p JOIN digests m ON m.spectrum_id = p.spectrum_id AND abs(p.x - (m.mass + {added})) < 0.003 * (m.mass + {added})) WHERE k = 1)"


DIGESTS = """,
digests AS (SELECT fragment_id, mass, fragment_id % (SELECT max(spectrum_id) + 1 FROM spectra) AS spectrum_id FROM masses)"""
ASSOC = PEAKS + MS + DIGESTS + ",\n" + _assoc_sql("plain", 0.0) + ",\n" + _assoc_sql("modified", 45.0)


def _digests(spark, d) -> DataFrame:
    """Every mass as a fragment of one spectrum's sample."""
    n = _spectra(spark, d).agg((F.max("spectrum_id") + 1).alias("n"))
    return _masses(spark, d).join(F.broadcast(n), F.lit(True)).withColumn("spectrum_id", F.col("fragment_id") % F.col("n")).drop("n")  # n: one row


def _associated(spark, d, added: float) -> DataFrame:
    return P.associate(_peaks(spark, d), _digests(spark, d), 0.003, added)


@query("sp25_association", ASSOC, "SELECT 'plain' AS form, spectrum_id, fragment_id, idx FROM plain UNION ALL SELECT 'modified', spectrum_id, fragment_id, idx FROM modified")
def sp25(spark, d):
    out = [_associated(spark, d, m).select(F.lit(f).alias("form"), "spectrum_id", "fragment_id", "idx") for f, m in (("plain", 0.0), ("modified", 45.0))]
    return out[0].unionByName(out[1])


PAIRED = ASSOC + """,
single AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY spectrum_id, idx) AS n FROM plain) WHERE n = 1 AND fragment_id % 3 <> 0),
paired AS (SELECT s.spectrum_id, s.fragment_id, s.idx, s.y, m.idx AS modified_idx, m.y AS modified_y FROM single s JOIN modified m ON m.spectrum_id = s.spectrum_id AND m.fragment_id = s.fragment_id)"""


def _paired(spark, d) -> DataFrame:
    reactive = _masses(spark, d).select("fragment_id", F.expr("if(fragment_id % 3 = 0, 2, 1)").alias("n_sites"))
    return P.disambiguate(_associated(spark, d, 0.0), _associated(spark, d, 45.0), reactive)


@query("sp26_disambiguation", PAIRED, "SELECT spectrum_id, fragment_id, idx, modified_idx FROM paired")
def sp26(spark, d):
    return _paired(spark, d).select("spectrum_id", "fragment_id", "idx", "modified_idx")


@query("sp27_without_ambiguous", PEAKS, "SELECT spectrum_id, idx FROM peaks p WHERE NOT EXISTS (SELECT 1 FROM peaks o WHERE o.spectrum_id = p.spectrum_id AND o.idx <> p.idx AND abs(p.x - o.x) < 0.02 * o.x AND (p.y < o.y OR (p.y = o.y AND p.idx > o.idx)))")
def sp27(spark, d):
    return P.without_ambiguous(_peaks(spark, d), 0.02).select("spectrum_id", "idx")


PROF = PEAKS + """,
prof AS (SELECT p.spectrum_id, p.timepoint, p.replicate, p.idx AS peak, max(CASE WHEN s.idx = p.idx THEN s.y END) AS height,
  sum(greatest(s.y - CASE WHEN b.x > a.x THEN a.y + (b.y - a.y) * (s.x - a.x) / (b.x - a.x) ELSE a.y END, 0)) AS area
  FROM peaks p JOIN spectra a ON a.spectrum_id = p.spectrum_id AND a.idx = p."left" JOIN spectra b ON b.spectrum_id = p.spectrum_id AND b.idx = p."right" JOIN spectra s ON s.spectrum_id = p.spectrum_id AND s.idx BETWEEN p."left" AND p."right" GROUP BY ALL)"""


def _profiles(spark, d) -> DataFrame:
    return P.peak_profiles(_spectra(spark, d), _peaks(spark, d))


@query("sp28_peak_profiles", PROF, "SELECT spectrum_id, timepoint, replicate, peak, height, round(area, 3) AS area FROM prof")
def sp28(spark, d):
    return rounded(_profiles(spark, d), "area", digits=3)


@query("sp29_reaction_profiles", PROF + MS + ",\n" + PAIRED[len(PEAKS + MS) + 2:], """
, u AS (SELECT fragment_id, timepoint, 'plain' AS form, height, area FROM paired JOIN prof ON prof.spectrum_id = paired.spectrum_id AND peak = idx UNION ALL SELECT fragment_id, timepoint, 'modified', height, area FROM paired JOIN prof ON prof.spectrum_id = paired.spectrum_id AND peak = modified_idx)
SELECT fragment_id, timepoint, form, round(avg(height), 3) AS height, round(avg(area), 3) AS area, count(*) AS n FROM u GROUP BY ALL""")
def sp29(spark, d):
    return rounded(P.reaction_profiles(_profiles(spark, d), _paired(spark, d)), "height", "area", digits=3)


STD = PROF + """,
byt AS (SELECT peak, timepoint, avg(area) AS area FROM prof GROUP BY ALL),
n1 AS (SELECT *, area / avg(area) OVER (PARTITION BY timepoint) AS a FROM byt), n2 AS (SELECT peak, area, a / avg(a) OVER (PARTITION BY peak) AS a FROM n1),
cv AS (SELECT * FROM (SELECT peak, stddev_samp(a) / avg(a) AS cv, avg(area) AS mean_area, count(*) AS n_times FROM n2 GROUP BY peak) WHERE cv IS NOT NULL),
lim AS (SELECT greatest(0.15::DOUBLE, 0.15::DOUBLE + 0.05::DOUBLE * ceil((max(cv) - 0.15::DOUBLE) / 0.05::DOUBLE)) AS lim FROM (SELECT cv FROM cv ORDER BY cv, peak LIMIT 3)),
std AS (SELECT cv.*, cv <= lim AS chosen FROM cv, lim)"""


@query("sp30_internal_standards", STD, "SELECT peak, round(cv, 4) AS cv, round(mean_area, 3) AS mean_area, n_times, chosen FROM std")
def sp30(spark, d):
    out = P.internal_standards(_profiles(spark, d))
    return out.select("peak", F.round("cv", 4).alias("cv"), F.round("mean_area", 3).alias("mean_area"), "n_times", "chosen")


@query("sp31_apply_standards", STD, "SELECT spectrum_id, idx, round(y * f, 2) AS y FROM spectra JOIN (SELECT timepoint, avg(10000 / area) / 100 AS f FROM prof WHERE area > 0 AND peak IN (SELECT peak FROM std WHERE chosen) GROUP BY 1) USING (timepoint)")
def sp31(spark, d):
    p = _profiles(spark, d)
    return rounded(P.apply_standards(_spectra(spark, d), p, P.internal_standards(p)).select("spectrum_id", "idx", "y"), "y", digits=2)


@query("sp32_unexplained_peaks", NEAREST, "SELECT spectrum_id, idx FROM peaks p WHERE NOT EXISTS (SELECT 1 FROM near n WHERE n.spectrum_id = p.spectrum_id AND n.fragment_id % 2 = 0 AND abs(p.x - n.x) <= 0.001 * n.x)")
def sp32(spark, d):
    return P.unexplained(_peaks(spark, d), _near(spark, d).where("fragment_id % 2 = 0"), 0.001).select("spectrum_id", "idx")


@query("sp33_overview", NEAREST, """
, loq AS (SELECT spectrum_id, 0.1 * stddev_samp(y) AS loq FROM spectra GROUP BY 1)
SELECT p.spectrum_id, any_value(p.timepoint) AS timepoint, count(*) AS n_peaks, count(*) FILTER (p.y > loq) AS n_over, count(n.fragment_id) AS n_associated FROM peaks p JOIN loq USING (spectrum_id) LEFT JOIN near n ON n.spectrum_id = p.spectrum_id AND n.idx = p.idx GROUP BY 1""")
def sp33(spark, d):
    loq = _spectra(spark, d).groupBy("spectrum_id").agg((0.1 * F.stddev_samp("y")).alias("loq"))
    p = _peaks(spark, d).join(loq, "spectrum_id").join(_near(spark, d).select("spectrum_id", "idx", "fragment_id"), ["spectrum_id", "idx"], "left")
    return p.groupBy("spectrum_id").agg(F.any_value("timepoint").alias("timepoint"), F.count("*").alias("n_peaks"), F.count_if(F.col("y") > F.col("loq")).alias("n_over"), F.count("fragment_id").alias("n_associated"))


@query("sp34_autoscale", SP, "SELECT spectrum_id, round(sum(y), 3) AS total, round(max(sum(y)) OVER () / sum(y), 4) AS ratio FROM spectra WHERE y > 0.5 GROUP BY 1")
def sp34(spark, d):
    out = P.autoscale(_spectra(spark, d))
    return out.select("spectrum_id", F.round("total", 3).alias("total"), F.round("ratio", 4).alias("ratio"))
