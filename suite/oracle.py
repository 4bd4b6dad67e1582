"""The registered queries as SQL over the given tables."""

from suite import fixtures as fx

KEYS = "stack_id, channel"
TILE = "tile_y0, tile_x0"


def r(expr, name, digits=6):
    return f"round(({expr})::DOUBLE, {digits}) + 0.0::DOUBLE AS {name}"


def with_(*parts):
    return "WITH " + ",\n".join(p.strip() for p in parts) + "\n"


def shape_of(source, name="shp"):
    return f"{name} AS (SELECT {KEYS}, max(y) + 1 AS h, max(x) + 1 AS w FROM {source} GROUP BY {KEYS})"


def crop_sql(source, fraction, name="cropped"):
    """Centred crop, counted from 0 again."""
    n = lambda s: f"floor({s} * {fraction}::DOUBLE)::BIGINT"
    y0, x0 = f"((h - {n('h')}) // 2)", f"((w - {n('w')}) // 2)"
    return f"""{shape_of(source, name + "_shp")},
{name} AS (
  SELECT {KEYS}, frame, y - {y0} AS y, x - {x0} AS x, intensity
  FROM {source} JOIN {name}_shp USING ({KEYS})
  WHERE y >= {y0} AND y < {y0} + {n('h')} AND x >= {x0} AND x < {x0} + {n('w')}
)"""


def detrend_sql(source, window, name="dt", keys=KEYS):
    half = window // 2
    return f"""{name}_a AS (
  SELECT {keys}, frame, y, x, intensity,
         count(*) OVER p AS n, count(intensity) OVER p AS seen, avg(intensity) OVER p AS near,
         avg(intensity) OVER i AS level, count(*) OVER i = count(intensity) OVER i AS whole
  FROM {source}
  WINDOW p AS (PARTITION BY {keys}, y, x ORDER BY frame ROWS BETWEEN {half} PRECEDING AND {half} FOLLOWING),
         i AS (PARTITION BY {keys}, frame)
),
{name} AS (
  SELECT {keys}, frame, y, x, CASE WHEN whole AND seen = {window} THEN intensity - near + level END AS intensity
  FROM {name}_a WHERE n = {window}
)"""


def autocorr_sql(source, name="fc", keys=KEYS, max_lag=None):
    """Circular lag products of every image with itself."""
    limit = f"WHERE abs(dy) <= {max_lag[0]} AND abs(dx) <= {max_lag[1]}" if max_lag else ""
    # products are formed over row positions inside one image
    return f"""{name}_img AS (
  SELECT {keys}, frame, max(y) + 1 AS h, max(x) + 1 AS w, avg(intensity) AS m,
         count(*) = count(intensity) AS whole, list(intensity ORDER BY y, x) AS v
  FROM {source} GROUP BY {keys}, frame
),
{name}_lag AS (
  SELECT *, CASE WHEN a <= (h - 1) // 2 THEN a ELSE a - h END AS dy,
            CASE WHEN b <= (w - 1) // 2 THEN b ELSE b - w END AS dx
  FROM (SELECT *, unnest(range(w)) AS b FROM (SELECT *, unnest(range(h)) AS a FROM {name}_img))
),
{name}_sel AS (SELECT * FROM {name}_lag {limit}),
{name}_pair AS (
  SELECT {keys}, frame, dy, dx, h, w, m, whole, a, b, v, unnest(range(h * w)) AS i FROM {name}_sel
),
{name} AS (
  SELECT {keys}, frame, dy, dx,
         CASE WHEN whole AND m <> 0 THEN
           sum(v[i + 1] * v[((i // w + a) % h) * w + (i % w + b) % w + 1]) / (h * w * m * m) - 1.0 END AS g
  FROM {name}_pair GROUP BY {keys}, frame, dy, dx, h, w, m, whole
)"""


def mean_map_sql(source="fc", name="mm", keys=KEYS, bessel="reduced", window=3, none_left="no_valid_frame"):
    factor = "n_frames / nullif(n_frames - 1, 0)::DOUBLE"
    need = "2"
    if bessel == "original":
        factor = f"(n_rows + {window - 1}) / (n_rows + {window - 2})::DOUBLE"
        need = "1"
    return f"""{name} AS (
  SELECT {keys}, dy, dx, CASE WHEN n_frames > 0 THEN mean_g * ({factor}) END AS g, n_frames, n_rows,
         CASE WHEN n_rows < {need} THEN 'too_few_frames' WHEN n_frames = 0 THEN '{none_left}' WHEN n_frames < {need} THEN 'too_few_frames' WHEN n_frames < n_rows THEN 'frames_skipped' ELSE 'ok' END AS status
  FROM (SELECT {keys}, dy, dx, avg(g) AS mean_g, count(g) AS n_frames, count(*) AS n_rows
        FROM {source} GROUP BY {keys}, dy, dx)
)"""


def bootstrap_sql(source="fc", name="bs", keys=KEYS, reps=10, seed=7):
    return f"""{name}_n AS (SELECT {keys}, count(DISTINCT frame) AS n, min(frame) AS f0 FROM {source} GROUP BY {keys}),
{name}_draw AS (
  SELECT {keys}, rep.range AS rep,
         f0 + ('0x' || substr(md5('{seed}|' || rep.range::VARCHAR || '|' || d::VARCHAR), 1, 8))::BIGINT % n AS frame
  FROM (SELECT *, unnest(range(n)) AS d FROM {name}_n) CROSS JOIN range({reps}) rep
),
{name}_w AS (SELECT {keys}, rep, frame, count(*) AS k FROM {name}_draw GROUP BY ALL),
{name}_rep AS (
  SELECT {keys}, rep, dy, dx, sum(k * g) / sum(k) AS g
  FROM {source} JOIN {name}_w USING ({keys}, frame) GROUP BY {keys}, rep, dy, dx
),
{name} AS (
  SELECT {keys}, dy, dx, stddev_pop(g) * any_value(n) / (any_value(n) - 1)::DOUBLE AS g_sd, any_value(n) AS n_frames
  FROM {name}_rep JOIN {name}_n USING ({keys}) GROUP BY {keys}, dy, dx
)"""


def bootstrap_gaps_sql(source="fc", name="bs", reps=10, seed=7):
    """:func:`bootstrap_sql` where some frames have no correlation: replicates divide by the draws that have one."""
    plain = bootstrap_sql(source, name, KEYS, reps, seed)
    found = f"(SELECT {KEYS}, dy, dx, count(g) AS have FROM {source} GROUP BY {KEYS}, dy, dx)"
    return (
        plain.replace("sum(k * g) / sum(k) AS g", "sum(k * g) / sum(k) FILTER (WHERE g IS NOT NULL) AS g")
        .replace("any_value(n) / (any_value(n) - 1)::DOUBLE AS g_sd, any_value(n)", "any_value(have) / (any_value(have) - 1)::DOUBLE AS g_sd, any_value(have)")
        .replace(f"JOIN {name}_n USING ({KEYS}) GROUP", f"JOIN {found} h USING ({KEYS}, dy, dx) GROUP")
    )


#: Embedding images with the position of each in its series as its number.
PLACED = f"""placed AS (
  SELECT {KEYS}, dense_rank() OVER (PARTITION BY {KEYS} ORDER BY frame) - 1 AS frame, y, x, intensity FROM vec
)"""


def fit_sql(source, model="2D", keys=KEYS, name="ft"):
    """Grid search of D with the best amplitude and offset in closed form."""
    low = "0.1" if model == "1D" else "0.001"
    n_grid = 20 if model == "1D" else 28
    row = "AND dy = 0" if model == "1D" else ""
    shape_model = "2D" if model == "1D" else model
    f = fx.shape_sql(shape_model, "d", "s", "t")
    parts = [
        f"""{name}_l AS (SELECT {keys}, g AS y, s_lag AS s, t_lag AS t FROM {source} WHERE NOT (dy = 0 AND dx = 0) {row}),
{name}_b AS (
  SELECT {keys}, count(*) AS n, count(y) AS seen, sum(y) AS sy, sum(y * y) AS syy, greatest(max(y), 0.0) AS top
  FROM {name}_l GROUP BY {keys}
),
{name}_c0 AS (SELECT {keys}, range AS c, {low}::DOUBLE * pow(10.0::DOUBLE, range / 4.0::DOUBLE) AS d FROM {name}_b CROSS JOIN range({n_grid + 1}))"""
    ]
    for number in range(4):
        parts.append(
            f"""{name}_m{number} AS (
  SELECT {keys}, c, any_value(d) AS d, sum(f) AS f, sum(f * f) AS ff, sum(f * y) AS fy
  FROM (SELECT {keys}, c, d, y, {f} AS f FROM {name}_l JOIN {name}_c{number} USING ({keys})) GROUP BY {keys}, c
),
{name}_x{number} AS (
  SELECT *, top * 1.5::DOUBLE AS amax, top * 0.1::DOUBLE AS omax, n * ff - f * f AS det
  FROM {name}_m{number} JOIN {name}_b USING ({keys})
),
{name}_y{number} AS (
  SELECT *, greatest(-omax, least(omax, CASE WHEN det > 1e-12 * n * ff THEN (ff * sy - f * fy) / det ELSE 0.0 END)) AS o1
  FROM {name}_x{number}
),
{name}_z{number} AS (
  SELECT *, greatest(0.0, least(amax, coalesce((fy - o1 * f) / nullif(ff, 0.0), 0.0))) AS a FROM {name}_y{number}
),
{name}_o{number} AS (SELECT *, greatest(-omax, least(omax, (sy - a * f) / n)) AS o FROM {name}_z{number}),
{name}_s{number} AS (
  SELECT *, syy - 2.0 * a * fy - 2.0 * o * sy + a * a * ff + 2.0 * a * o * f + n * o * o AS cost FROM {name}_o{number}
),
{name}_r{number} AS (
  SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY round_even(cost / nullif(syy, 0.0) * 1e12::DOUBLE, 0), c) AS rank,
         lag(cost) OVER q AS below, lead(cost) OVER q AS above
  FROM {name}_s{number} WINDOW q AS (PARTITION BY {keys} ORDER BY c)
),
{name}_p{number} AS (
  SELECT *, CASE WHEN below + above - 2.0 * cost > 0 THEN
    greatest(-1.0, least(1.0, (below - above) * 0.5 / (below + above - 2.0 * cost))) END AS vertex
  FROM {name}_r{number} WHERE rank = 1
)"""
        )
        if number < 2:
            step = 0.25 / 8 ** (number + 1)
            parts.append(
                f"""{name}_c{number + 1} AS (
  SELECT {keys}, k.range + 8 AS c,
         greatest({low}::DOUBLE, least(10000.0::DOUBLE, d * pow(10.0::DOUBLE, k.range * {step}::DOUBLE))) AS d
  FROM {name}_p{number} CROSS JOIN range(-8, 9) k
)"""
            )
        elif number == 2:
            step = 0.25 / 64
            parts.append(
                f"""{name}_c3 AS (
  SELECT {keys}, 0 AS c, d FROM {name}_p2
  UNION ALL
  SELECT {keys}, 1, greatest({low}::DOUBLE, least(10000.0::DOUBLE, d * pow(10.0::DOUBLE, coalesce(vertex, 0.0) * {step}::DOUBLE)))
  FROM {name}_p2
)"""
            )
    factor = "0.35" if model == "3D" else "0.5"
    ok = lambda e: f"CASE WHEN st = 'ok' THEN {e} END"
    parts.append(
        f"""{name} AS (
  SELECT {keys}, '{model}' AS model, {ok('d')} AS diff_coeff, {ok('a')} AS amplitude, {ok('o')} AS offset_,
         {ok('greatest(cost, 0.0)')} AS cost, {ok(f'{factor}::DOUBLE / nullif(a, 0.0)')} AS particle_number,
         {ok('(a * f + n * o - sy) / (n + 1)')} AS residual_mean, n AS n_lags, st AS status
  FROM (SELECT *, CASE WHEN seen < n THEN 'missing_map' WHEN n < 3 OR top <= 0 THEN 'degenerate' ELSE 'ok' END AS st
        FROM {name}_p3)
)"""
    )
    return ",\n".join(parts)


def fit_select(digits=6, name="ft"):
    floats = ["diff_coeff", "amplitude", "cost", "particle_number", "residual_mean"]
    return (
        f"SELECT {KEYS}, model, {', '.join(r(c, c, digits) for c in floats)}, {r('offset_', 'offset', digits)},"
        f" n_lags::BIGINT AS n_lags, status FROM {name}"
    )


def tiles_sql(source, size, step, name="tl", side=fx.SIDE):
    count = (side - size) // step + 1
    return f"""{name} AS (
  SELECT {KEYS}, ty.range * {step} AS tile_y0, tx.range * {step} AS tile_x0, frame,
         y - ty.range * {step} AS y, x - tx.range * {step} AS x, intensity
  FROM {source} CROSS JOIN range({count}) ty CROSS JOIN range({count}) tx
  WHERE y >= ty.range * {step} AND y < ty.range * {step} + {size}
    AND x >= tx.range * {step} AND x < tx.range * {step} + {size}
)"""


def paint_sql(source, columns, size, step, name="pt", side=fx.SIDE):
    """Every pixel takes the values of the last tile over it, row by row."""
    picked = ", ".join(columns)
    return f"""{name}_grid AS (
  SELECT {KEYS}, a.range AS py, b.range AS px
  FROM (SELECT DISTINCT {KEYS} FROM {source}) CROSS JOIN range({side}) a CROSS JOIN range({side}) b
),
{name} AS (
  SELECT {KEYS}, py AS y, px AS x, {picked} FROM (
    SELECT g.stack_id, g.channel, g.py, g.px, {", ".join("t." + c for c in columns)},
           row_number() OVER (PARTITION BY g.stack_id, g.channel, py, px
                              ORDER BY tile_y0 DESC NULLS LAST, tile_x0 DESC NULLS LAST) AS rank
    FROM {name}_grid g LEFT JOIN {source} t
      ON t.stack_id = g.stack_id AND t.channel = g.channel
     AND py >= tile_y0 AND py < tile_y0 + {size} AND px >= tile_x0 AND px < tile_x0 + {size})
  WHERE rank = 1
)"""


def median3_sql(source, columns, name="md", side=fx.SIDE):
    top = side - 1
    picked = ", ".join(f"CASE WHEN any_value(c.{c}) IS NOT NULL THEN median(n.{c}) END AS {c}" for c in columns)
    return f"""{name} AS (
  SELECT c.stack_id, c.channel, c.y, c.x, {picked}
  FROM {source} c CROSS JOIN range(-1, 2) oy CROSS JOIN range(-1, 2) ox
  JOIN {source} n ON n.stack_id = c.stack_id AND n.channel = c.channel
   AND n.y = greatest(0, least({top}, c.y + oy.range)) AND n.x = greatest(0, least({top}, c.x + ox.range))
  GROUP BY c.stack_id, c.channel, c.y, c.x
)"""


def tile_chain(size=8, step=4, source=None, image="cube", model="2D", side=fx.SIDE, geo=None):
    """Tiles to fitted tiles: the local map before painting."""
    keys = f"{KEYS}, {TILE}"
    return ",\n".join(
        [
            (source or fx.CUBE).strip(),
            tiles_sql(image, size, step, side=side),
            detrend_sql("tl", 3, "dt", keys),
            autocorr_sql("dt", "fc", keys),
            mean_map_sql("fc", "mm", keys, "original"),
            geo or f"geo AS (SELECT *, {fx.SPACE}::DOUBLE AS s_lag, {fx.TIME}::DOUBLE AS t_lag FROM mm)",
            fit_sql("geo", model, keys),
            f"br AS (SELECT {keys}, CASE WHEN count(*) = count(intensity) THEN stddev_pop(intensity) END AS brightness FROM tl GROUP BY {keys})",
            f"""tf AS (SELECT {keys}, log10(diff_coeff) AS log_d, diff_coeff, amplitude AS amp, offset_, cost, particle_number, status, brightness
  FROM ft JOIN br USING ({keys}))""",
        ]
    )


def drift_sql(source, name="dr", side=fx.SIDE):
    """Smoothed zero-padded correlation with the first frame, first maximum."""
    n, lo = side // 2, (side - side // 2) // 2
    mirror = lambda p: f"(CASE WHEN ((({p}) % {2 * n}) + {2 * n}) % {2 * n} < {n} THEN ((({p}) % {2 * n}) + {2 * n}) % {2 * n} ELSE {2 * n - 1} - ((({p}) % {2 * n}) + {2 * n}) % {2 * n} END)"
    return f"""{name}_roi AS (
  SELECT {KEYS}, frame, y - {lo} AS y, x - {lo} AS x, intensity FROM {source}
  WHERE y >= {lo} AND y < {lo + n} AND x >= {lo} AND x < {lo + n}
),
{name}_cc AS (
  SELECT f.stack_id, f.channel, f.frame, r.y - f.y + {n // 2} AS py, r.x - f.x + {n // 2} AS px, sum(r.intensity * f.intensity) AS c
  FROM {name}_roi f JOIN {name}_roi r ON r.stack_id = f.stack_id AND r.channel = f.channel AND r.frame = 0
  WHERE f.frame > 0 AND r.y - f.y >= -{n // 2} AND r.y - f.y <= {(n - 1) // 2 if n % 2 else n // 2 - 1}
    AND r.x - f.x >= -{n // 2} AND r.x - f.x <= {(n - 1) // 2 if n % 2 else n // 2 - 1}
  GROUP BY ALL
),
{name}_k AS (
  SELECT range AS o, exp(-0.125::DOUBLE * range * range) / (SELECT sum(exp(-0.125::DOUBLE * range * range)) FROM range(-8, 9)) AS w
  FROM range(-8, 9)
),
{name}_sy AS (
  SELECT c.stack_id, c.channel, c.frame, p.range AS py, c.px, sum(c.c * k.w) AS c
  FROM range({n}) p CROSS JOIN {name}_k k JOIN {name}_cc c ON c.py = {mirror("p.range + k.o")} GROUP BY ALL
),
{name}_sx AS (
  SELECT c.stack_id, c.channel, c.frame, c.py, p.range AS px, sum(c.c * k.w) AS c
  FROM range({n}) p CROSS JOIN {name}_k k JOIN {name}_sy c ON c.px = {mirror("p.range + k.o")} GROUP BY ALL
),
{name}_pk AS (
  SELECT *, row_number() OVER (PARTITION BY {KEYS}, frame
      ORDER BY round(c / top, 12) DESC, py, px) AS rank
  FROM (SELECT *, max(abs(c)) OVER (PARTITION BY {KEYS}, frame) AS top FROM {name}_sx)
),
{name} AS (
  SELECT {KEYS}, frame, py - {n // 2} AS dy, px - {n // 2} AS dx FROM {name}_pk WHERE rank = 1
  UNION ALL
  SELECT DISTINCT {KEYS}, 0::BIGINT, 0::BIGINT, 0::BIGINT FROM {source}
)"""


def roll_sql(source, drift, name, h, w):
    return f"""{name} AS (
  SELECT s.stack_id, s.channel, s.frame, (((s.y + d.dy) % {h}) + {h}) % {h} AS y, (((s.x + d.dx) % {w}) + {w}) % {w} AS x, s.intensity
  FROM {source} s JOIN {drift} d USING ({KEYS}, frame)
)"""


PIX = f"{KEYS}, frame::BIGINT AS frame, y::BIGINT AS y, x::BIGINT AS x"
LAG = f"{KEYS}, dy::BIGINT AS dy, dx::BIGINT AS dx"
FLAG = f"{KEYS}, frame::BIGINT AS frame, dy::BIGINT AS dy, dx::BIGINT AS dx"
CUBE_CORR = ",\n".join([fx.CUBE.strip(), detrend_sql("cube", 3), autocorr_sql("dt")])
EV_DRIFT = f"""fixed AS (SELECT DISTINCT {KEYS}, frame, frame % 3 - 1 AS dy, (frame * 2) % 5 - 2 AS dx FROM ev)"""
ACQ = """
acq AS (
  SELECT stack_id, 1::BIGINT AS channel, pixel_size_nm,
         first_dwell * CASE WHEN k % 2 = 0 THEN 2 ELSE 1 END AS pixel_dwell_us
  FROM meta
),
acql AS (SELECT *, pixel_dwell_us * 256 * 1e-3::DOUBLE AS line_time_ms FROM acq)"""
TRUTH = "SELECT *, true_a * {shape} + {o} AS model_g FROM maps"
PAINTED = ",\n".join(
    [
        fx.CUBE.strip(),
        tiles_sql("cube", 7, 4),
        f"""br AS (SELECT {KEYS}, {TILE}, CASE WHEN tile_y0 <> 4 OR tile_x0 <> 4 THEN stddev_pop(intensity) END AS brightness
  FROM tl GROUP BY {KEYS}, {TILE})""",
        paint_sql("br", ["brightness"], 7, 4),
    ]
)


def _trace():
    return with_(fx.EVENTS, crop_sql("ev", 0.25)) + (
        f"SELECT {KEYS}, frame::BIGINT AS frame, {r('avg(intensity)', 'mean_intensity')} FROM cropped GROUP BY {KEYS}, frame"
    )


def _pixels(*parts, source, digits=6):
    return with_(*parts) + f"SELECT {PIX}, {r('intensity', 'intensity', digits)} FROM {source}"


def _model(model):
    value = f"true_a * {fx.shape_sql(model, 'true_d')} + 0.01"
    return with_(fx.part_maps_sql(model)) + f"SELECT {LAG}, {r(value, 'model_g')} FROM maps"


RESIDUALS = with_(fx.part_maps_sql(), f"ev2 AS (SELECT *, true_a * {fx.shape_sql('2D', 'true_d')} + 0.002::DOUBLE AS model_g FROM maps)",
    "res AS (SELECT *, CASE WHEN dy = 0 AND dx = 0 THEN 0.0 ELSE model_g - g END AS residual FROM ev2)")

MAP_COLUMNS = f"{LAG}, {r('mm.g', 'g')}, {r('bs.g_sd', 'g_sd')}, mm.n_frames::BIGINT AS n_frames, status"
WITH_SD = f"SELECT {MAP_COLUMNS} FROM mm LEFT JOIN bs USING ({KEYS}, dy, dx)"
MEAN_COLUMNS = f"{LAG}, {r('g', 'g')}, n_frames::BIGINT AS n_frames, status"


def _fit_job():
    return with_(
        fx.META,
        ACQ,
        fx.part_maps_sql(),
        f"""joined AS (
  SELECT m.stack_id, m.channel, m.dy, m.dx, m.g,
         coalesce(a.pixel_size_nm, 20.0) * 1e-3::DOUBLE AS px, coalesce(a.pixel_dwell_us, 50.0) * 1e-6::DOUBLE AS dwell,
         coalesce(a.line_time_ms, 12.8) * 1e-3::DOUBLE AS line
  FROM maps m LEFT JOIN acql a ON a.stack_id = split_part(m.stack_id, '_', 1) AND a.channel = m.channel
  WHERE m.dy >= -8 AND m.dy < 8 AND m.dx >= -12 AND m.dx < 12
),
geo AS (SELECT *, px * px * (dx * dx + dy * dy) AS s_lag, abs(dwell * dx + line * dy) AS t_lag FROM joined)""",
        fit_sql("geo"),
        "ftl AS (SELECT * REPLACE (log10(diff_coeff) AS diff_coeff) FROM ft)",
    ) + fit_select(4, "ftl")


ORACLE = {
    "stack_shape": with_(fx.EVENTS)
    + f"SELECT {KEYS}, max(frame)::BIGINT + 1 AS n_frames, max(y)::BIGINT + 1 AS height, max(x)::BIGINT + 1 AS width FROM ev GROUP BY {KEYS}",
    "frame_stats": with_(fx.CUBE)
    + f"SELECT {KEYS}, frame::BIGINT AS frame, {r('avg(intensity)', 'mean_intensity')}, count(*)::BIGINT AS n_pixels FROM cube GROUP BY {KEYS}, frame",
    "mean_projection": with_(fx.EVENTS)
    + f"SELECT {KEYS}, y::BIGINT AS y, x::BIGINT AS x, {r('avg(intensity)', 'mean_intensity')} FROM ev GROUP BY {KEYS}, y, x",
    "intensity_trace": _trace(),
    "intensity_trace_pixels": _trace(),
    "first_last_frame": with_(fx.CUBE)
    + f"SELECT {PIX}, {r('intensity', 'intensity')}, CASE WHEN frame = 0 THEN 'first' ELSE 'last' END AS which FROM cube WHERE frame IN (0, 11)",
    "crop_center": _pixels(fx.EVENTS, crop_sql("ev", 0.3), source="cropped"),
    "crop_center_pixels": _pixels(fx.EVENTS, crop_sql("ev", 0.3), source="cropped"),
    "array_roundtrip": _pixels(fx.VEC, source="vec"),
    "detrend_w3": _pixels(fx.CUBE, detrend_sql("cube", 3), source="dt", digits=9),
    "detrend_w5": _pixels(fx.CUBE, detrend_sql("cube", 5), source="dt", digits=9),
    "detrend_frames": _pixels(fx.CUBE, detrend_sql("cube", 3), source="dt", digits=9),
    "detrend_holes": _pixels(fx.HOLES, detrend_sql("holes", 3), source="dt", digits=9),
    "frame_autocorr": with_(fx.CUBE, autocorr_sql("cube")) + f"SELECT {FLAG}, {r('g', 'g')} FROM fc",
    "frame_autocorr_few": with_(fx.CUBE, autocorr_sql("cube", max_lag=(3, 2))) + f"SELECT {FLAG}, {r('g', 'g')} FROM fc",
    "frame_autocorr_fft": with_(fx.CUBE, autocorr_sql("cube")) + f"SELECT {FLAG}, {r('g', 'g')} FROM fc",
    "frame_autocorr_vec": with_(fx.VEC, autocorr_sql("vec")) + f"SELECT {FLAG}, {r('g', 'g')} FROM fc",
    "frame_autocorr_events": with_(fx.EVENTS, autocorr_sql("ev")) + f"SELECT {FLAG}, {r('g', 'g')} FROM fc",
    "mean_corr_map": with_(CUBE_CORR, mean_map_sql()) + f"SELECT {MEAN_COLUMNS} FROM mm",
    "mean_corr_map_original": with_(CUBE_CORR, mean_map_sql(bessel="original")) + f"SELECT {MEAN_COLUMNS} FROM mm",
    "bootstrap_sd": with_(CUBE_CORR, bootstrap_sql())
    + f"SELECT {LAG}, {r('g_sd', 'g_sd')}, n_frames::BIGINT AS n_frames FROM bs",
    "map_with_sd": with_(CUBE_CORR, mean_map_sql(), bootstrap_sql())
    + f"SELECT {LAG}, {r('mm.g', 'g')}, mm.n_frames::BIGINT AS n_frames, status, {r('bs.g_sd', 'g_sd')} "
    f"FROM mm LEFT JOIN (SELECT * FROM bs WHERE channel = 0) bs USING ({KEYS}, dy, dx)",
    "blank_zero_lag": with_(CUBE_CORR, mean_map_sql())
    + f"SELECT {LAG}, {r('CASE WHEN dy = 0 AND dx = 0 THEN 0 ELSE g END', 'g')}, n_frames::BIGINT AS n_frames, status FROM mm",
    "crop_lags": with_(CUBE_CORR, mean_map_sql())
    + f"SELECT {MEAN_COLUMNS} FROM mm WHERE dx + 8 >= 4 AND dx + 8 < 12 AND dy + 8 >= 5 AND dy + 8 < 10",
    "fast_axis_cut": with_(CUBE_CORR, mean_map_sql())
    + f"SELECT {MEAN_COLUMNS}, {r('dx * 0.02::DOUBLE', 'distance_um')} FROM mm WHERE dy = 0",
    "correlation_map_job": with_(CUBE_CORR, mean_map_sql(), bootstrap_sql())
    + f"SELECT {LAG}, {r('mm.g', 'g')}, {r('bs.g_sd', 'g_sd')}, mm.n_frames::BIGINT AS n_frames, status FROM mm JOIN bs USING ({KEYS}, dy, dx)",
    "correlation_map_vec": with_(
        fx.VEC, PLACED, detrend_sql("placed", 3), autocorr_sql("dt"), mean_map_sql(), bootstrap_sql()
    )
    + f"SELECT {LAG}, {r('mm.g', 'g')}, {r('bs.g_sd', 'g_sd')}, mm.n_frames::BIGINT AS n_frames, status FROM mm JOIN bs USING ({KEYS}, dy, dx)",
    "bootstrap_vec": with_(fx.VEC, PLACED, autocorr_sql("placed"), bootstrap_sql())
    + f"SELECT {LAG}, {r('g_sd', 'g_sd')}, n_frames::BIGINT AS n_frames FROM bs",
    "correlation_map_cropped": with_(
        fx.CUBE, crop_sql("cube", 0.5), detrend_sql("cropped", 5), autocorr_sql("dt"), mean_map_sql(bessel="original", window=5, none_left="zero_mean"), bootstrap_gaps_sql()
    )
    + WITH_SD,
    "correlation_map_drift": with_(
        fx.ROLLED,
        drift_sql("rolled"),
        roll_sql("rolled", "dr", "fixed_", fx.SIDE, fx.SIDE),
        detrend_sql("fixed_", 3),
        autocorr_sql("dt"),
        mean_map_sql(),
        bootstrap_sql(),
    )
    + WITH_SD,
    "correlation_map_holes": with_(fx.SOME_HOLES, detrend_sql("holes", 3), autocorr_sql("dt"), mean_map_sql(), bootstrap_gaps_sql()) + WITH_SD,
    "correlation_map_none": with_(fx.HOLES)
    + f"SELECT DISTINCT {KEYS}, a.range::BIGINT AS dy, b.range::BIGINT AS dx, NULL::DOUBLE AS g, NULL::DOUBLE AS g_sd, 0::BIGINT AS n_frames, 'missing_pixels' AS status "
    f"FROM holes CROSS JOIN range(-{fx.SIDE // 2}, {fx.SIDE // 2}) a CROSS JOIN range(-{fx.SIDE // 2}, {fx.SIDE // 2}) b",
    "correlation_map_wide": with_(
        fx.WIDE_CUBE,
        detrend_sql("wd", 3),
        f"sizes AS (SELECT {KEYS}, frame, avg(intensity) AS m FROM dt GROUP BY {KEYS}, frame)",
        f"""moved AS MATERIALIZED (
  SELECT {KEYS}, frame, a.range AS dy, b.range AS dx, (y - a.range + {fx.WIDE}) % {fx.WIDE} AS y, (x - b.range + {fx.WIDE}) % {fx.WIDE} AS x, intensity AS other
  FROM dt CROSS JOIN range(-2, 3) a CROSS JOIN range(-2, 3) b
),
still AS MATERIALIZED (SELECT * FROM dt)""",
        f"""fc AS (
  SELECT {KEYS}, frame, dy, dx, total / ({fx.WIDE * fx.WIDE} * m * m) - 1.0 AS g
  FROM (SELECT {KEYS}, frame, dy, dx, sum(intensity * other) AS total FROM moved JOIN still USING ({KEYS}, frame, y, x) GROUP BY ALL)
  JOIN sizes USING ({KEYS}, frame)
)""",
        mean_map_sql(),
        bootstrap_sql(),
    )
    + WITH_SD,
    "correlation_map_faults": with_(fx.CUBE, fx.faulty_sql("cube"), detrend_sql("faulty", 3), autocorr_sql("dt"), mean_map_sql(), bootstrap_gaps_sql())
    + WITH_SD
    + f" UNION ALL SELECT {KEYS}, NULL, NULL, NULL, NULL, 0, status FROM faulty_status",
    "series_status": with_(fx.CUBE, fx.faulty_sql("cube")) + f"SELECT {KEYS}, status FROM faulty_status",
    "drift_faults": with_(fx.ROLLED, drift_sql("rolled"))
    + f"SELECT {KEYS}, frame::BIGINT AS frame, CASE WHEN bad THEN NULL ELSE dy END::BIGINT AS dy, CASE WHEN bad THEN NULL ELSE dx END::BIGINT AS dx"
    " FROM (SELECT *, stack_id LIKE 'A%' AND frame = 5 OR stack_id LIKE 'R%' AND frame > 0 AS bad FROM dr)"
    " UNION ALL SELECT stack_id, NULL, frame::BIGINT, NULL, NULL FROM dr WHERE stack_id LIKE 'N%' AND frame < 3",
    "acq_extract": with_(fx.META, ACQ)
    + f"SELECT stack_id, channel, {r('pixel_size_nm', 'pixel_size_nm')}, {r('pixel_dwell_us', 'pixel_dwell_us')}, {r('line_time_ms', 'line_time_ms')} FROM acql",
    "acq_attach": with_(
        fx.META,
        ACQ,
        f"""j AS (
  SELECT p.stack_id, p.channel, coalesce(a.pixel_size_nm, 20.0) AS px, coalesce(a.pixel_dwell_us, 50.0) AS dw, coalesce(a.line_time_ms, 12.8) AS li
  FROM (SELECT p_partkey::VARCHAR || '_scan_RICScorr' AS stack_id, (p_partkey % 2)::BIGINT AS channel FROM part) p
  LEFT JOIN acql a ON a.stack_id = split_part(p.stack_id, '_', 1) AND a.channel = p.channel)""",
    )
    + f"SELECT {KEYS}, {r('px', 'pixel_size_nm')}, {r('dw', 'pixel_dwell_us')}, {r('li', 'line_time_ms')}, {r('px * 1e-3', 'pixel_um')}, "
    f"{r('dw * 1e-6', 'dwell_s')}, {r('li * 1e-3', 'line_s')}, replace(stack_id, 'RICScorr', 'RICSunc') AS partner FROM j",
    "lag_geometry": with_(fx.part_maps_sql()) + f"SELECT {LAG}, {r('s_lag', 's_lag')}, {r('t_lag', 't_lag')} FROM maps",
    "model_2d": _model("2D"),
    "model_3d": _model("3D"),
    "model_residual": RESIDUALS + f"SELECT {LAG}, {r('g', 'g')}, {r('model_g', 'model_g')}, {r('residual', 'residual')} FROM res",
    "fit_cost": RESIDUALS
    + f"SELECT {KEYS}, {r('sum(residual * residual)', 'cost')}, {r('avg(residual)', 'residual_mean')} FROM res GROUP BY {KEYS}",
    "particle_number": f"SELECT p_partkey::VARCHAR || '_scan_RICScorr' AS stack_id, (p_partkey % 2)::BIGINT AS channel, "
    f"{r('0.5::DOUBLE / (0.2::DOUBLE + (p_partkey % 7) * 0.1::DOUBLE)', 'n_2d')}, {r('0.35::DOUBLE / (0.2::DOUBLE + (p_partkey % 7) * 0.1::DOUBLE)', 'n_3d')} FROM part",
    "fit_2d": with_(fx.part_maps_sql("2D"), fit_sql("maps", "2D")) + fit_select(),
    "fit_3d": with_(fx.part_maps_sql("3D"), fit_sql("maps", "3D")) + fit_select(),
    "fit_fast_axis": with_(fx.part_maps_sql("2D"), fit_sql("maps", "1D")) + fit_select(),
    "fit_scaled": with_(fx.part_maps_sql("2D"), fit_sql("maps", "2D")) + fit_select(),
    "fit_edges": with_(
        fx.part_maps_sql("2D"),
        "lifted AS (SELECT * REPLACE (true_a * 0.4::DOUBLE - g * CASE WHEN channel = 0 THEN 0.3 ELSE -3.0 END::DOUBLE AS g) FROM maps)",
        fit_sql("lifted", "2D"),
    )
    + f"SELECT {KEYS}, {r('CASE WHEN amplitude > 1e-6 THEN log10(diff_coeff) END', 'log_d', 4)}, {r('amplitude', 'amplitude', 4)}, {r('offset_', 'offset', 4)}, {r('cost', 'cost', 4)}, n_lags::BIGINT AS n_lags, status FROM ft",
    "fit_job": _fit_job(),
    "fit_job_models": with_(
        fx.part_maps_sql("2D"),
        fit_sql("maps", "2D", name="f2"),
        fit_sql("maps", "1D", name="f1"),
        "both_ AS (SELECT * REPLACE (log10(diff_coeff) AS diff_coeff) FROM (SELECT * FROM f2 UNION ALL SELECT * FROM f1))",
    )
    + fit_select(4, "both_"),
    "fit_residual": with_(fx.part_maps_sql("2D"), fit_sql("maps", "2D"))
    + f"SELECT {LAG}, {r('g', 'g', 4)}, {r('fit', 'model_g', 4)}, {r('CASE WHEN dy = 0 AND dx = 0 THEN 0 ELSE fit - g END', 'residual', 4)}"
    f" FROM (SELECT {KEYS}, dy, dx, g, amplitude * {fx.shape_sql('2D', 'diff_coeff')} + offset_ AS fit FROM maps JOIN ft USING ({KEYS}))",
    "tile_assign": with_(fx.CUBE, tiles_sql("cube", 8, 4))
    + f"SELECT {KEYS}, {TILE}, count(*)::BIGINT AS n_pixels, {r('sum(intensity * (y * 31 + x * 7 + frame + 1))', 'checksum')} FROM tl GROUP BY {KEYS}, {TILE}",
    "tile_valid": with_(fx.HOLES, tiles_sql("holes", 8, 4))
    + f"SELECT {KEYS}, {TILE}, count(intensity)::BIGINT AS n_pixels FROM tl GROUP BY {KEYS}, {TILE} HAVING count(intensity) >= 0.5 * count(*)",
    "tile_brightness": with_(fx.CUBE, tiles_sql("cube", 7, 4))
    + f"SELECT {KEYS}, {TILE}, {r('stddev_pop(intensity)', 'brightness')} FROM tl GROUP BY {KEYS}, {TILE}",
    "paint_tiles": with_(PAINTED) + f"SELECT {KEYS}, y::BIGINT AS y, x::BIGINT AS x, {r('brightness', 'brightness')} FROM pt",
    "median3": with_(PAINTED, median3_sql("pt", ["brightness"]))
    + f"SELECT {KEYS}, y::BIGINT AS y, x::BIGINT AS x, {r('brightness', 'brightness')} FROM md",
    "map_range": with_(PAINTED)
    + f"SELECT {KEYS}, {r('median(brightness)', 'median')}, {r('median(brightness) * 0.5', 'low')}, {r('median(brightness) * 2', 'high')} FROM pt GROUP BY {KEYS}",
    "tile_fit": with_(tile_chain())
    + f"SELECT {KEYS}, {TILE}, {r('log_d', 'log_d', 4)}, {r('amp', 'amp', 4)}, {r('brightness', 'brightness', 4)}, {r('log10(nullif(cost, 0))', 'log_cost', 4)}, status FROM tf",
    "local_diffusion_map": with_(
        tile_chain(), paint_sql("tf", ["diff_coeff", "amp", "brightness"], 8, 4), median3_sql("pt", ["diff_coeff", "amp", "brightness"])
    )
    + f"SELECT {KEYS}, y::BIGINT AS y, x::BIGINT AS x, {r('log10(diff_coeff)', 'd', 4)}, {r('amp', 'amp', 4)}, {r('brightness', 'brightness', 4)} FROM md",
    "local_map_acq": with_(
        fx.META,
        ACQ,
        tile_chain(
            source=",\n".join([fx.CUBE.strip(), "named AS (SELECT * REPLACE (split_part(stack_id, '_', 2) || '_' || split_part(stack_id, '_', 1) AS stack_id, intensity + 50.0 AS intensity) FROM cube)", crop_sql("named", 0.75)]),
            image="cropped",
            model="3D",
            side=12,
            geo=f"""geo AS (
  SELECT * EXCLUDE (px, dwell, line), px * px * (dx * dx + dy * dy) AS s_lag, abs(dwell * dx + line * dy) AS t_lag FROM (
    SELECT m.*, coalesce(a.pixel_size_nm, 20.0) * 1e-3::DOUBLE AS px, coalesce(a.pixel_dwell_us, 50.0) * 1e-6::DOUBLE AS dwell,
           coalesce(a.line_time_ms, 12.8) * 1e-3::DOUBLE AS line
    FROM mm m LEFT JOIN acql a ON a.stack_id = split_part(m.stack_id, '_', 1) AND a.channel = m.channel))""",
        ),
        paint_sql("tf", ["diff_coeff", "amp", "brightness", "particle_number"], 8, 4, side=12),
        median3_sql("pt", ["diff_coeff", "amp", "brightness", "particle_number"], side=12),
    )
    + f"SELECT {KEYS}, y::BIGINT AS y, x::BIGINT AS x, {r('log10(diff_coeff)', 'd', 4)}, {r('amp', 'amp', 4)}, {r('brightness', 'brightness', 4)}, {r('log10(particle_number)', 'particle_number', 4)} FROM md",
    "local_map_faults": with_(
        tile_chain(source=",\n".join([fx.CUBE.strip(), fx.faulty_sql("cube")]), image="faulty"),
        paint_sql("tf", ["diff_coeff", "amp", "brightness"], 8, 4),
        median3_sql("pt", ["diff_coeff", "amp", "brightness"]),
    )
    + f"SELECT {KEYS}, y::BIGINT AS y, x::BIGINT AS x, {r('log10(diff_coeff)', 'd', 4)}, {r('amp', 'amp', 4)}, {r('brightness', 'brightness', 4)}, 'ok' AS status FROM md"
    f" UNION ALL SELECT {KEYS}, NULL, NULL, NULL, NULL, NULL, status FROM faulty_status",
    "local_fast_axis": with_(tile_chain())
    + f"SELECT {KEYS}, {TILE}, dx::BIGINT AS dx, {r('dx * 0.02::DOUBLE', 'distance_um', 4)}, {r('CASE WHEN dx = 0 THEN 0 ELSE g END', 'g', 4)}, "
    f"{r('amp * ' + fx.shape_sql('2D', 'diff_coeff') + ' + offset_', 'model_g', 4)} FROM geo JOIN tf USING ({KEYS}, {TILE}) WHERE dy = 0 AND tf.status = 'ok'",
    "drift_estimate": with_(fx.ROLLED, drift_sql("rolled")) + f"SELECT {FLAG} FROM dr",
    "drift_apply": _pixels(fx.EVENTS, EV_DRIFT, roll_sql("ev", "fixed", "moved", fx.SIDE, fx.HOURS), source="moved"),
    "drift_apply_pixels": _pixels(fx.EVENTS, EV_DRIFT, roll_sql("ev", "fixed", "moved", fx.SIDE, fx.HOURS), source="moved"),
    "drift_correct": _pixels(
        fx.ROLLED, drift_sql("rolled"), roll_sql("rolled", "dr", "moved", fx.SIDE, fx.SIDE), source="moved"
    ),
    "scan_stack": with_(fx.CUBE)
    + f"SELECT {PIX}, {r('intensity', 'intensity')} FROM cube WHERE channel = 1 AND frame BETWEEN 2 AND 4",
    "list_inputs": "SELECT c_mktsegment AS segment, c_nationkey::BIGINT AS nation, '.txt' AS extension, length(count(*)::VARCHAR)::BIGINT + 1 AS n_bytes"
    " FROM customer GROUP BY ALL",
    "write_read_maps": with_(CUBE_CORR, mean_map_sql(), bootstrap_sql()) + WITH_SD + " WHERE channel = 0",
    "append_fits": with_(fx.part_maps_sql("2D"), fit_sql("maps", "2D", name="f2"), fit_sql("maps", "3D", name="f3"))
    + " UNION ALL ".join(
        f"SELECT stack_id AS filepath, {r('particle_number', '\"Particle Number\"')}, {r('diff_coeff', '\"Diffusion Coefficient\"')},"
        f" {r('residual_mean', 'residual')}, model FROM {name}"
        for name in ("f2", "f3")
    ),
    "local_map_written": with_(
        fx.CUBE,
        tiles_sql("cube", 8, 4),
        f"""br AS (SELECT {KEYS}, {TILE}, CASE WHEN tile_y0 <> 4 OR tile_x0 <> 4 THEN stddev_pop(intensity) END AS brightness
  FROM tl GROUP BY {KEYS}, {TILE})""",
        paint_sql("br", ["brightness"], 8, 4),
    )
    + f"SELECT {KEYS}, y::BIGINT AS y, x::BIGINT AS x, {r('brightness', 'brightness')} FROM pt",
}

# the same results by another path
ORACLE["median3_pixels"] = ORACLE["median3"]
ORACLE["map_range_pixels"] = ORACLE["map_range"]
ORACLE["frame_autocorr_strips"] = ORACLE["frame_autocorr"]
ORACLE["correlation_map_stored"] = ORACLE["correlation_map_job"]
