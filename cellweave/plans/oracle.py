"""DuckDB SQL that gives the same rows as the queries, written from the definitions and the same specifications."""

from __future__ import annotations

from math import cos, exp, floor, pi, sin

from cellweave.plans.queries import BANK, CORNER, LINES, MULTI, ONE, TILES, E, L, ODD, V
from cellweave.spec import FeatureSpec

# Tables that the engine has too are written out here, so that a wrong one there does not go unseen.
#: Pixel offsets (rows, columns) of eight angles at distances 1 and 2.
PAIR_OFFSETS = [(0, 1), (1, 1), (1, 0), (1, -1), (0, 2), (1, 2), (2, 1), (2, 0), (2, -1), (1, -2)]
#: Linear colour transform of (red, green, blue).
RGB_CIE = ((0.1387, 0.6708, 0.0611), (0.0999, 0.8017, 0.0984), (0.0, 0.0660, 0.8910))
#: Samples and radius of the layers of binary patterns.
PATTERNS = ((8, 1), (16, 2), (32, 4))


def blur_weights() -> list[float]:
    """Three weights of a Gaussian of deviation 3."""
    w = [exp(-x * x / 18) for x in (-1, 0, 1)]
    return [x / sum(w) for x in w]


def bank_rows(k: int) -> list[str]:
    """(layer, dr, dc, weight in millionths) of eight kernels of deviation 3, wavelength 10, aspect 0.5 and phase 1, normalised to 2 / 3."""
    reach, out = (k - 1 if k % 2 == 0 else k) // 2, []
    for layer in range(8):
        angle = pi * 4 * layer / 32
        value = {}
        for dr in range(-reach, reach + 1):
            for dc in range(-reach, reach + 1):
                x, y = -dc, -dr  # the kernel is laid out from its far corner
                along, across = x * cos(angle) + y * sin(angle), y * cos(angle) - x * sin(angle)
                value[dr, dc] = exp(-(along**2 + 0.25 * across**2) / 18) * cos(2 * pi * along / 10 + 1)
        total = 1.5 * sum(value.values())
        out += [f"({layer}, {dr}, {dc}, {floor(v / total * 1e6 + 0.5)})" for (dr, dc), v in value.items()]
    return out


def lines_from_centre(k: int, skip: int) -> list[list[tuple[int, int]]]:
    """Lines to every ``skip``-th border pixel, left, right, top, bottom: for each step the exact place, halves away from the centre."""
    m = k // 2
    ends = [(e, 0) for e in range(0, k, skip)] + [(e, k - 1) for e in range(0, k, skip)] + [(0, e) for e in range(0, k, skip)] + [(k - 1, e) for e in range(0, k, skip)]
    out = []
    for r, c in ends:
        n = max(abs(r - m), abs(c - m))
        near = lambda d, i, n=n: int(abs(d) * i / n + 0.5) * (1 if d > 0 else -1)
        out.append([(m + near(r - m, i), m + near(c - m, i)) for i in range(n + 1)])
    return out

RASTER_E = """e AS (
  SELECT r, CAST(c AS BIGINT) AS c, least(greatest(CAST(floor((CAST(x AS DOUBLE) + 1e0) * 127.5e0) AS BIGINT), 0), 255) AS v
  FROM (SELECT vec_id AS r, unnest(embedding) AS x, unnest(generate_series(0, len(embedding) - 1)) AS c FROM embeddings))"""
RASTER_E5 = RASTER_E + ",\ne5 AS (SELECT r, c, CAST(floor(CAST(v AS DOUBLE) / 255e0 * 31e0) AS BIGINT) AS v FROM e)"
RASTER_L = """items AS (
  SELECT l_orderkey % 96 AS r, l_partkey % 96 AS c, max(l_quantity) AS q, max(l_tax) AS t, max(l_discount) AS d, max(l_extendedprice) AS p FROM lineitem GROUP BY 1, 2),
l AS (
  SELECT CAST(i // 96 AS BIGINT) AS r, CAST(i % 96 AS BIGINT) AS c, coalesce(CAST(floor(q) AS BIGINT) * 200, 0) AS b1, coalesce(CAST(floor(t * 100 + 0.5e0) AS BIGINT) * 1000, 0) AS b2,
    coalesce(CAST(floor(d * 100 + 0.5e0) AS BIGINT) * 1000, 0) AS b3, coalesce(CAST(least(10000, floor(p / 10)) AS BIGINT), 0) AS b4
  FROM (SELECT unnest(generate_series(0, 9215)) AS i) LEFT JOIN items ON items.r = i // 96 AND items.c = i % 96)"""
MASK_V = """seen AS (SELECT DISTINCT user_id AS r, CAST(hour(ts) AS BIGINT) AS c FROM events),
px AS (
  SELECT g.r, g.c, CASE WHEN seen.r IS NULL THEN 0 ELSE 1 END AS v
  FROM (SELECT r, c FROM (SELECT unnest(generate_series(0, (SELECT max(r) FROM seen))) AS r), (SELECT unnest(generate_series(0, 23)) AS c)) g LEFT JOIN seen ON seen.r = g.r AND seen.c = g.c)"""


def level(column: str, top: int) -> str:
    """A band of L as whole numbers 0 .. top."""
    return f"CAST(floor(least(greatest(CAST({column} AS DOUBLE), 0e0), 10000e0) / 10000e0 * {top}e0) AS BIGINT)"


def every_band(make) -> str:
    """The rows of a query of each band of L, with the band."""
    return "\nUNION ALL\n".join(f"SELECT {n} AS band, * FROM ({make(n)})" for n in (1, 2, 3, 4))


def band(n: int, top: int = 255) -> str:
    return f"{RASTER_L},\npx AS (SELECT r, c, {level(f'b{n}', top)} AS v FROM l)"


def windows(spec: FeatureSpec, source: str = "px", columns: str = "v", only: int | None = None) -> str:
    """CTEs up to p: a row for every pixel (lr, lc) of every window (k, bi, bj), of all scales or of one, of clipped size (h, w)."""
    scales = ", ".join(f"({k}, {spec.offset(k)})" for k in spec.scales if only in (None, k))
    b, halo = spec.block, spec.halo
    cells = lambda n: f"CAST(ceil(({n} - {halo}) / {b}e0) AS BIGINT) - 1"
    values = ", ".join(f"q.{c.strip()}" for c in columns.split(","))
    return f"""
g AS (SELECT max(r) + 1 AS nr, max(c) + 1 AS nc FROM {source}),
kk(k, o) AS (VALUES {scales}),
w1 AS (SELECT k, o, nr, nc, bi, unnest(generate_series(0, {cells('nc')})) AS bj FROM (SELECT *, unnest(generate_series(0, {cells('nr')})) AS bi FROM g, kk)),
w2 AS (SELECT k, bi, bj, bi * {b} + o AS r0, bj * {b} + o AS c0, least(k, nr - (bi * {b} + o)) AS h, least(k, nc - (bj * {b} + o)) AS w FROM w1),
w3 AS (SELECT *, unnest(generate_series(0, w - 1)) AS lc FROM (SELECT *, unnest(generate_series(0, h - 1)) AS lr FROM w2)),
p AS (SELECT CAST(k AS INTEGER) AS k, bi, bj, h, w, lr, lc, {values} FROM w3 JOIN {source} q ON q.r = r0 + lr AND q.c = c0 + lc)"""


def mean_of(spec: FeatureSpec, ctes: str, digits: int = 0, source: str = "px") -> str:
    """Weighted mean and mean square deviation of every window of ``source``."""
    unit = f"1e{digits}"
    value = "v" if not digits else f"CAST(floor(v * 1e{digits} + 0.5e0) AS BIGINT)"
    d = "sqrt((lc - k / 2e0) * (lc - k / 2e0) + (lr - k / 2e0) * (lr - k / 2e0))"
    return f"""WITH {ctes},{windows(spec, source)},
s AS (
  SELECT k, bi, bj, count(*) AS n, sum({value} * CASE WHEN {d} > 0 THEN CAST(floor(1e9 / {d} + 0.5e0) AS BIGINT) ELSE 0 END) AS sw, sum({value}) AS s1, sum({value} * {value}) AS s2
  FROM p GROUP BY k, bi, bj),
m AS (SELECT *, CAST(sw AS DOUBLE) / 1e9 / n / {unit} AS mean FROM s)
SELECT k, bi, bj, mean, CAST(s2 AS DOUBLE) / {unit} / {unit} / n - 2e0 * mean * (CAST(s1 AS DOUBLE) / {unit} / n) + mean * mean * n / n AS var FROM m"""


def extents(source: str = "e") -> str:
    return f"x AS (SELECT max(r) + 1 AS rows, max(c) + 1 AS cols FROM {source})"


def cells(n: str, b: str, s: str) -> str:
    return f"greatest(0, CAST(ceil(({n} - ({s} - {b})) / CAST({b} AS DOUBLE)) AS BIGINT))"


def sections(spec: FeatureSpec) -> str:
    size, halo, b = spec.section_size, spec.halo, spec.block
    return f"""{RASTER_E}, {extents()},
z AS (SELECT *, least({size}, rows) AS sr, least({size}, cols) AS sc FROM x),
y AS (SELECT *, greatest(1, sr - {halo}) AS step_r, greatest(1, sc - {halo}) AS step_c FROM z),
i AS (SELECT *, CAST(ceil(rows / CAST(step_r AS DOUBLE)) AS BIGINT) AS n_r, CAST(ceil(cols / CAST(step_c AS DOUBLE)) AS BIGINT) AS n_c FROM y),
j AS (SELECT *, unnest(generate_series(0, n_r * n_c - 1)) AS id FROM i),
t AS (SELECT *, id + 1 AS section, id // n_c * step_r AS r0, id % n_c * step_c AS c0 FROM j),
sections AS (
  SELECT section, r0, c0, least(sr, rows - r0) AS h, least(sc, cols - c0) AS w, greatest(0, CAST(ceil((least(sr, rows - r0) - {halo}) / {b}e0) AS BIGINT)) AS out_rows,
    greatest(0, CAST(ceil((least(sc, cols - c0) - {halo}) / {b}e0) AS BIGINT)) AS out_cols FROM t)"""


def index_sql(formula: str) -> str:
    colours = ", ".join(f"least(CAST(b{i} AS DOUBLE), 10000e0) / 10000e0 AS {x}" for i, x in enumerate(("blue", "green", "red", "nir"), 1))
    return mean_of(L, f"{RASTER_L},\nf AS (SELECT r, c, {colours} FROM l),\npx AS (SELECT r, c, floor(coalesce({formula}, 0e0) * 1e6 + 0.5e0) / 1e6 AS v FROM f)", 6)


def shifted(source: str, at: list[tuple[int, int]], value: str = "v", mode: str = "reflect") -> str:
    """CTEs up to n: source with values v0, v1, ... at (r + dr, c + dc); mode says how edges are mirrored ('none': null)."""
    first = 1 if mode == "reflect" else 0

    def place(x: str, d: int, n: str) -> str:
        if mode == "none":
            return f"{x} + {d}"
        return f"CASE WHEN {x} + {d} < 0 THEN -({x} + {d}) - {first} WHEN {x} + {d} >= {n} THEN 2 * {n} - 2 + {first} - ({x} + {d}) ELSE {x} + {d} END"

    joins = "".join(f"\n  LEFT JOIN {source} s{i} ON s{i}.r = {place('a.r', dr, 'nr')} AND s{i}.c = {place('a.c', dc, 'nc')}" for i, (dr, dc) in enumerate(at))
    values = ", ".join(f"s{i}.{x} AS {x}{i}" for i in range(len(at)) for x in value.split(","))
    return f"z AS (SELECT max(r) + 1 AS nr, max(c) + 1 AS nc FROM {source}),\nn AS (SELECT a.*, {values} FROM {source} a CROSS JOIN z{joins})"


def gradient(source: str) -> str:
    ctes = shifted(source, [(-1, -1), (-1, 0), (0, -1), (0, 0)])
    a, b, d, e = (f"sqrt(CAST(v{i} AS DOUBLE))" for i in range(4))
    total = f"abs({d} - {b}) + abs({e} - {a}) + abs({d} + {e} - {a} - {b}) + abs({b} + {e} - {a} - {d})"
    return f"{ctes},\ngrad AS (SELECT r, c, CAST(floor(({total}) * {2.0**0.5 / 4!r} + 1e-9) AS BIGINT) AS v FROM n)"


def colours() -> str:
    at = [(dr, dc) for dr in (-1, 0, 1) for dc in (-1, 0, 1)]
    w = [int(x * 1e6 + 0.5) for x in blur_weights()]
    total = sum(w) ** 2
    scaled = ", ".join(f"CAST(floor(least(greatest(CAST(b{i} AS DOUBLE), 0e0), 10000e0) / 10000e0 * 1e6 + 0.5e0) AS BIGINT) AS b{i}" for i in (1, 2, 3))
    blurred = ", ".join("CAST(" + " + ".join(f"b{i}{x} * {w[dr + 1] * w[dc + 1]}" for x, (dr, dc) in enumerate(at)) + f" AS DOUBLE) / {total}e0 / 1e6 * 2e0 - 1e0 AS p{i}" for i in (1, 2, 3))
    mixed = ", ".join(f"CAST(floor((p3 * {m[0]!r}e0 + p2 * {m[1]!r}e0 + p1 * {m[2]!r}e0) * 1e9 + 0.5e0) AS BIGINT) AS {x}" for m, x in zip(RGB_CIE, "xyz", strict=True))
    means = ", ".join(f"CAST(sum({x}) AS DOUBLE) / count(*) / 1e9 AS {x}" for x in "xyz")
    again = ", ".join(f"CAST(sum(CAST(floor({x} * 1e9 + 0.5e0) AS BIGINT)) AS DOUBLE) / count(*) / 1e9 AS {x}" for x in "xyz")
    return f"""{RASTER_L},
base AS (SELECT r, c, {scaled} FROM l),
{shifted('base', at, 'b1,b2,b3', 'reflect101')},
flat AS (SELECT r, c, {blurred} FROM n),
colour AS (SELECT r, c, {mixed} FROM flat),
means AS (SELECT {again} FROM (SELECT {means} FROM colour GROUP BY r // 48, c // 48))"""


def saliency() -> str:
    far = " + ".join(f"(CAST(colour.{x} AS DOUBLE) / 1e9 - means.{x}) * (CAST(colour.{x} AS DOUBLE) / 1e9 - means.{x})" for x in "xyz")
    return f"{colours()},\npx AS (SELECT r, c, CAST(floor((least(0e0 + {far}, 1e0) + 1e0) / 2e0 * 255e0) AS BIGINT) AS v FROM colour, means)"


def smooth() -> str:
    disc = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if i * i + j * j <= 1]
    weight = [f"exp(CAST(-(v{x} - v) * (v{x} - v) AS DOUBLE) / {2 * 0.1**2!r}) * {exp(-(i * i + j * j) / (2 * 0.1**2))!r}" for x, (i, j) in enumerate(disc)]
    top = " + ".join(f"{w} * v{x}" for x, w in enumerate(weight))
    return f"WITH {RASTER_E},\n{shifted('e', disc, 'v', 'reflect101')}\nSELECT r, c, CAST(floor(({top}) / ({' + '.join(weight)}) + 0.5e0) AS BIGINT) AS v FROM n"


def pantex(spec: FeatureSpec, source: str, ctes: str) -> str:
    """CTEs up to contrast(k, bi, bj, contrast)."""
    squares = ", ".join(f"(v{i} - v) * (v{i} - v) AS q{i}" for i in range(len(PAIR_OFFSETS)))
    inside = lambda dr, dc: f"lr + {dr} < h AND lc + {dc} < w AND lc + {dc} >= 0"
    sums = ", ".join(f"avg(CASE WHEN {inside(dr, dc)} THEN q{i} END) AS a{i}" for i, (dr, dc) in enumerate(PAIR_OFFSETS))
    names = ", ".join(f"q{i}" for i in range(len(PAIR_OFFSETS)))
    return f"""{ctes},
{shifted(source, PAIR_OFFSETS, 'v', 'none')},
pairs AS (SELECT r, c, {squares} FROM n),{windows(spec, 'pairs', names)},
contrast AS (SELECT k, bi, bj, coalesce(least({', '.join(f'a{i}' for i in range(len(PAIR_OFFSETS)))}), 0e0) AS contrast FROM (SELECT k, bi, bj, {sums} FROM p GROUP BY k, bi, bj))"""


def lacunarity(spec: FeatureSpec, source: str, ctes: str) -> str:
    """CTEs up to lac(k, bi, bj, lacunarity)."""
    r = spec.box
    side = f"CAST(least({r}, h - x * {r}, w - y * {r}) AS DOUBLE)"
    return f"""{ctes},{windows(spec, source)},
boxes AS (SELECT k, bi, bj, lr // {r} AS x, lc // {r} AS y, min(v) AS lo, max(v) AS hi, min(h) AS h, min(w) AS w FROM p GROUP BY ALL),
mass AS (SELECT k, bi, bj, CAST(ceil(greatest(hi, 1) / {side}) - ceil(lo / {side}) + 1 AS BIGINT) AS m FROM boxes),
share AS (SELECT k, bi, bj, m, count(*) AS n FROM mass GROUP BY ALL),
lac AS (SELECT k, bi, bj, sum(n) * CAST(sum(m * m * n * n) AS DOUBLE) / (CAST(sum(m * n * n) AS DOUBLE) * CAST(sum(m * n * n) AS DOUBLE)) AS lacunarity FROM share GROUP BY k, bi, bj)"""


def folded(values: str, of: str = "x") -> str:
    """The sum of an expression over a list, element after element."""
    return f"list_reduce(list_transform({values}, lambda x: {of}), lambda a, b: a + b)"


def moments_of(source: str, key: str, top: str) -> str:
    """Moments of the list a of every row."""
    n, third, fourth = "CAST(len(a) AS DOUBLE)", "(var * 0.5e0 * (var * 0.5e0) * (var * 0.5e0))", "(var * 0.5e0 * (var * 0.5e0) * (var * 0.5e0) * (var * 0.5e0))"
    shown = {"max": "list_max(a)", "mean": "m", "var": "var", "skew": f"{folded('d', 'x * x * x')} / {n} / nullif({third}, 0)", "kurt": f"{folded('d', 'x * x * x * x')} / {n} / nullif({fourth}, 0)"}
    columns = ", ".join(f"CASE WHEN {top} AND list_max(a) <> 0 THEN coalesce({x}, 0e0) ELSE 0e0 END AS {name}" for name, x in shown.items())
    return f"""m1 AS (SELECT *, {folded('a')} / {n} AS m FROM {source}),
m2 AS (SELECT *, list_transform(a, lambda x: x - m) AS d FROM m1),
m3 AS (SELECT *, {folded('d', 'x * x')} / nullif({n} - 1e0, 0) AS var FROM m2)
SELECT {key}, {columns} FROM m3"""


def hog() -> str:
    at = [(1, 0), (-1, 0), (0, 1), (0, -1)]
    return f"""WITH {RASTER_E},
{shifted('e', at, 'v', 'none')},
slopes AS (SELECT r, c, v, v0 - v1 AS gr, v2 - v3 AS gc FROM n),{windows(E, 'slopes', 'v, gr, gc')},
q AS (
  SELECT k, bi, bj, h, w, v, CAST(CASE WHEN lr > 0 AND lr < h - 1 THEN gr ELSE 0 END AS DOUBLE) AS y, CAST(CASE WHEN lc > 0 AND lc < w - 1 THEN gc ELSE 0 END AS DOUBLE) AS x FROM p),
a AS (SELECT *, CASE WHEN atan2(y, x) < 0 THEN degrees(atan2(y, x)) + 180e0 ELSE degrees(atan2(y, x)) END AS a0 FROM q),
b AS (SELECT *, least(CAST(floor((CASE WHEN a0 >= 180 THEN a0 - 180e0 ELSE a0 END) / 20e0) AS BIGINT), 8) AS bin FROM a),
s AS (SELECT k, bi, bj, bin, CAST(sum(CAST(floor(sqrt(x * x + y * y) * 1e6 + 0.5e0) AS BIGINT)) AS DOUBLE) / 1e6 AS g FROM b GROUP BY ALL),
t AS (SELECT k, bi, bj, max(v) AS top, CAST(min(h) * min(w) AS DOUBLE) AS area FROM p GROUP BY k, bi, bj),
u AS (SELECT k, bi, bj, top, bin, coalesce(g, 0e0) / area AS x FROM (SELECT *, unnest(generate_series(0, 8)) AS bin FROM t) LEFT JOIN s USING (k, bi, bj, bin)),
l0 AS (SELECT k, bi, bj, any_value(top) AS top, list(x ORDER BY bin) AS a FROM u GROUP BY k, bi, bj),
l1 AS (SELECT k, bi, bj, top, a AS raw, sqrt({folded('a', 'x * x')} + 1e-10) AS norm FROM l0),
l2 AS (SELECT k, bi, bj, top, list_transform(raw, lambda x: least(x / norm, 0.2e0)) AS cut FROM l1),
l3 AS (SELECT k, bi, bj, top, cut, sqrt({folded('cut', 'x * x')} + 1e-10) AS norm FROM l2),
l4 AS (SELECT k, bi, bj, top, list_transform(cut, lambda x: x / norm) AS a FROM l3),
{moments_of('l4', 'k, bi, bj', 'top > 0')}"""


def window_moments() -> str:
    """By exact power sums."""
    sums = ", ".join(f"CAST(sum({' * '.join(['v'] * p)}) AS DOUBLE) AS s{p}" for p in (1, 2, 3, 4))
    sd = "(var * 0.5e0)"
    shown = {"mean": "m", "var": "var", "skew": f"m3 / nullif({sd} * {sd} * {sd}, 0)", "kurt": f"m4 / nullif({sd} * {sd} * {sd} * {sd}, 0)"}
    columns = ", ".join(f"CASE WHEN mx = 0 THEN 0e0 ELSE coalesce({x}, 0e0) END AS {n}" for n, x in shown.items())
    return f"""WITH {RASTER_E},{windows(E, 'e')},
s AS (SELECT k, bi, bj, CAST(count(*) AS DOUBLE) AS n, CAST(max(v) AS DOUBLE) AS mx, {sums} FROM p GROUP BY k, bi, bj),
t AS (SELECT *, s1 / n AS m FROM s),
u AS (SELECT *, (s2 / n - m * m) * n / nullif(n - 1e0, 0) AS var, s3 / n - 3e0 * m * (s2 / n) + 2e0 * m * m * m AS m3, s4 / n - 4e0 * m * (s3 / n) + 6e0 * m * m * (s2 / n) - 3e0 * m * m * m * m AS m4 FROM t)
SELECT k, bi, bj, mx AS max, {columns} FROM u"""


def sfs(k: int) -> str:
    """The lines of one scale."""
    b, th = LINES.block, LINES.line_threshold
    rows = ", ".join(f"({i}, {step}, {r}, {c})" for i, line in enumerate(lines_from_centre(k, LINES.line_skip)) for step, (r, c) in enumerate(line))
    side = -(-k // LINES.line_skip)
    pairs = ", ".join(f"({a}, {z})" for e in range(side) for a, z in ((e, 3 * side + e), (side + e, 2 * side + e)))
    half = b // 2
    return f"""WITH {RASTER_E},{windows(LINES, 'e', only=k)},
rays(ray, step, lr, lc) AS (VALUES {rows}),
centre AS (SELECT k, bi, bj, avg(CAST(v AS DOUBLE)) AS ctr FROM p WHERE lr >= {k // 2 - half} AND lr < {k // 2 + half} AND lc >= {k // 2 - half} AND lc < {k // 2 + half} GROUP BY k, bi, bj),
along AS (
  SELECT k, bi, bj, ray, step, lr, lc, CAST(v AS DOUBLE) AS v, coalesce(sum(abs(ctr - v)) OVER (PARTITION BY k, bi, bj, ray ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0) AS ph
  FROM p JOIN rays USING (lr, lc) JOIN centre USING (k, bi, bj)),
walk AS (
  SELECT k, bi, bj, ray, count(*) FILTER (WHERE ph < {th}) AS n, count(*) AS steps, sum(v) FILTER (WHERE ph < {th}) AS s1, sum(v * v) FILTER (WHERE ph < {th}) AS s2
  FROM along GROUP BY k, bi, bj, ray),
line AS (
  SELECT k, bi, bj, w.ray, sqrt(CAST((y.lr - {k // 2}) * (y.lr - {k // 2}) + (y.lc - {k // 2}) * (y.lc - {k // 2}) AS DOUBLE)) AS d, (s2 - s1 * s1 / n) / n * 0.5e0 AS sd
  FROM walk w JOIN rays y ON y.ray = w.ray AND y.step = least(n, steps - 1)),
pairs(ray, other) AS (VALUES {pairs}),
orth AS (SELECT a.k, a.bi, a.bj, max(abs(a.d - z.d)) AS orthogonal FROM line a JOIN pairs USING (ray) JOIN line z ON z.k = a.k AND z.bi = a.bi AND z.bj = a.bj AND z.ray = other GROUP BY ALL)
SELECT k, bi, bj, round(max(d), 6) AS max, round(coalesce(min(d) FILTER (WHERE d <> 0), 0e0), 6) AS min, round(avg(d), 6) AS mean,
  round(sum(CASE WHEN sd > 1e-9 THEN 0.1e0 * (d - 1e0) / sd ELSE 0e0 END) / count(*), 6) AS wmean, round(stddev_pop(d), 6) AS std, round(any_value(orthogonal), 6) AS orthogonal
FROM line JOIN orth USING (k, bi, bj) GROUP BY k, bi, bj"""


DISTANCE = "sqrt((lc - k / 2e0) * (lc - k / 2e0) + (lr - k / 2e0) * (lr - k / 2e0))"
SUMS_OF_P = f"count(*) AS n, sum(v * CASE WHEN {DISTANCE} > 0 THEN CAST(floor(1e9 / {DISTANCE} + 0.5e0) AS BIGINT) ELSE 0 END) AS sw, sum(v) AS s1, sum(v * v) AS s2"
MEAN_OF_SUMS = "mean, CAST(s2 AS DOUBLE) / n - 2e0 * mean * (CAST(s1 AS DOUBLE) / n) + mean * mean AS var"


def gabor(n: int, k: int) -> str:
    """The bank of one scale over a band of L."""
    mirrored = lambda x, d: f"CASE WHEN {x} + {d} < 0 THEN -({x} + {d}) WHEN {x} + {d} >= 96 THEN 190 - ({x} + {d}) ELSE {x} + {d} END"
    return f"""WITH {band(n)},
bank(layer, dr, dc, weight) AS (VALUES {', '.join(bank_rows(k))}),
around AS (SELECT a.r, a.c, layer, weight, {mirrored('a.r', 'dr')} AS nr, {mirrored('a.c', 'dc')} AS nc FROM px a, bank WHERE weight <> 0),
flat AS (SELECT a.r, a.c, layer, least(greatest(CAST(floor(CAST(sum(weight * q.v) AS DOUBLE) / 1e6 + 0.5e0) AS BIGINT), 0), 255) AS v FROM around a JOIN px q ON q.r = a.nr AND q.c = a.nc GROUP BY a.r, a.c, layer),{windows(BANK, 'flat', 'layer, v', k)},
s AS (SELECT k, layer, bi, bj, {SUMS_OF_P} FROM p GROUP BY k, layer, bi, bj),
m AS (SELECT *, CAST(sw AS DOUBLE) / 1e9 / n AS mean FROM s)
SELECT k, CAST(layer AS INTEGER) AS layer, bi, bj, {MEAN_OF_SUMS} FROM m"""


def dmp(n: int) -> str:
    """The morphological profile of a band of L, section by section: erosions and their reconstructions, which a recursion grows until nothing moves."""
    step, size = L.step(), L.step() + L.halo
    filtered = lambda f, x, half, by: f"{f}({x}) OVER (PARTITION BY {by} ROWS BETWEEN {half} PRECEDING AND {half} FOLLOWING)"
    eroded = ",\n".join(
        f"h{i} AS (SELECT *, {filtered('min', f'e{i - 1}', i, 'tr, tc, s, r ORDER BY c')} AS x{i} FROM z{i - 1}), z{i} AS (SELECT *, {filtered('min', f'x{i}', i, 'tr, tc, s, c ORDER BY r')} AS e{i} FROM h{i})" for i in range(1, 8)
    )
    markers = " UNION ALL ".join(f"SELECT tr, tc, s, {i} AS layer, {i} AS half, r, c, own, e{i} AS v FROM z7" for i in range(1, 8))
    return f"""WITH RECURSIVE {band(n)},
sec AS (
  SELECT tr, tc, r, c, v FROM px, (SELECT unnest([0, 1]) AS tr), (SELECT unnest([0, 1]) AS tc)
  WHERE r >= tr * {step} AND r < tr * {step} + {size} AND c >= tc * {step} AND c < tc * {step} + {size}),
z0 AS (SELECT tr, tc, s, r, c, s * v AS own, s * v AS e0 FROM sec, (VALUES (1), (-1)) q(s)),
{eroded},
grown AS (
  SELECT tr, tc, s, layer, half, r, c, own, v, 0 AS turn FROM ({markers})
  UNION ALL
  SELECT tr, tc, s, layer, half, r, c, own, new AS v, turn + 1 FROM (
    SELECT *, least({filtered('max', 'y', 'half', 'tr, tc, s, layer, c ORDER BY r')}, own) AS new
    FROM (SELECT *, {filtered('max', 'v', 'half', 'tr, tc, s, layer, r ORDER BY c')} AS y FROM grown))
  QUALIFY bool_or(new <> v) OVER (PARTITION BY tr, tc, s, layer)),
opened AS (SELECT * FROM grown QUALIFY turn = max(turn) OVER (PARTITION BY tr, tc, s, layer)),
layers AS (SELECT tr, tc, s, layer, r, c, lag(v, 1, own) OVER (PARTITION BY tr, tc, s, r, c ORDER BY layer) - v AS d FROM opened),
stacks AS (SELECT tr, tc, r, c, list(d ORDER BY s DESC, layer) AS l FROM layers GROUP BY tr, tc, r, c),
slopes AS (SELECT tr, tc, r, c, CAST(trunc((l[2] - 3 * l[1] + 3 * l[14] - l[13]) / 2e0 / 14e0) AS BIGINT) & 255 AS v FROM stacks),{windows(L, 'slopes', 'tr, tc, v')},
s AS (SELECT k, bi, bj, {SUMS_OF_P} FROM p WHERE tr = bi * {L.block} // {step} AND tc = bj * {L.block} // {step} GROUP BY k, bi, bj),
m AS (SELECT *, CAST(sw AS DOUBLE) / 1e9 / n AS mean FROM s)
SELECT k, bi, bj, {MEAN_OF_SUMS} FROM m"""


def patterns() -> str:
    """CTEs up to counts(k, bi, bj, layer, code, n): binary patterns of E, 0 around the image, counted by window."""
    rows = []
    for layer, (samples, radius) in enumerate(PATTERNS):
        for x in range(samples):
            dr, dc = round(-radius * sin(2 * pi * x / samples), 5), round(radius * cos(2 * pi * x / samples), 5)
            rows.append(f"({layer}, {samples}, {x}, {floor(dr)}, {floor(dc)}, {dr - floor(dr)!r}e0, {dc - floor(dc)!r}e0)")
    at = lambda i, j: f"LEFT JOIN e q{i}{j} ON q{i}{j}.r = a.r + i + {i} AND q{i}{j}.c = a.c + j + {j}"
    v = lambda i, j: f"coalesce(q{i}{j}.v, 0)"
    return f"""{RASTER_E},
samples(layer, samples, x, i, j, fr, fc) AS (VALUES {', '.join(rows)}),
signs AS (
  SELECT a.r, a.c, layer, samples, x, CAST((1 - fr) * ((1 - fc) * {v(0, 0)} + fc * {v(0, 1)}) + fr * ((1 - fc) * {v(1, 0)} + fc * {v(1, 1)}) >= a.v - 1e-9 AS INTEGER) AS s
  FROM (SELECT * FROM e, samples) a {at(0, 0)} {at(0, 1)} {at(1, 0)} {at(1, 1)}),
rounds AS (SELECT *, lag(s) OVER w AS before, first_value(s) OVER w AS f, last_value(s) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS z FROM signs WINDOW w AS (PARTITION BY r, c, layer ORDER BY x)),
codes AS (
  SELECT r, c, layer, CASE WHEN sum(abs(s - coalesce(before, z))) <= 2 THEN sum(s) ELSE any_value(samples) + 1 END AS code FROM rounds GROUP BY r, c, layer),{windows(E, 'codes', 'layer, code')},
counts AS (SELECT k, bi, bj, layer, code, count(*) AS n FROM p GROUP BY ALL)"""


def pattern_histogram() -> str:
    bins = ", ".join(f"CAST(coalesce(sum(n) FILTER (WHERE layer = {x} AND code = {i}), 0) AS DOUBLE) AS p{p}_{i}" for x, (p, _) in enumerate(PATTERNS) for i in range(p + 2))
    return f"WITH {patterns()}\nSELECT k, bi, bj, {bins} FROM counts GROUP BY k, bi, bj"


def pattern_moments() -> str:
    inner = moments_of("lists", "k, bi, bj", "TRUE")
    head, _, tail = inner.rpartition("\nSELECT ")
    shown = ", ".join(f"round({x}, 6) AS {x}" for x in ("max", "mean", "var", "skew", "kurt"))
    return f"""WITH {patterns()},
tops AS (SELECT k, bi, bj, layer, greatest(CAST(max(code) AS BIGINT), layer + 1) AS top FROM counts GROUP BY k, bi, bj, layer),
bins AS (SELECT k, bi, bj, layer, unnest(generate_series(0, top)) AS code FROM tops),
lists AS (SELECT k, bi, bj, list(CAST(coalesce(n, 0) AS DOUBLE) ORDER BY layer, code) AS a FROM bins LEFT JOIN counts USING (k, bi, bj, layer, code) GROUP BY k, bi, bj),
{head},
shown AS (SELECT {tail})
SELECT k, bi, bj, {shown} FROM shown"""


def spectrum() -> str:
    """Ring means of the log power spectrum of E's windows by plain sums of cosines and sines."""
    angle = "2e0 * pi() * (CAST((u * lr) % k AS DOUBLE) / k + CAST((f * lc) % k AS DOUBLE) / k)"
    place = lambda x: f"(({x} + k // 2) % k - (k - 1) / 2e0)"
    return f"""WITH {RASTER_E},{windows(E, 'e')},
freq AS (SELECT k, u, unnest(generate_series(0, k - 1)) AS f FROM (SELECT k, unnest(generate_series(0, k - 1)) AS u FROM (SELECT DISTINCT k FROM p))),
waves AS (SELECT k, bi, bj, u, f, sqrt(sum(v * cos({angle})) * sum(v * cos({angle})) + sum(v * sin({angle})) * sum(v * sin({angle}))) AS x, sum(v) AS total FROM p JOIN freq USING (k) GROUP BY k, bi, bj, u, f),
levels AS (
  SELECT k, bi, bj, CAST(floor(sqrt({place('f')} * {place('f')} + {place('u')} * {place('u')})) AS BIGINT) AS ring, CASE WHEN x >= 1e-9 * greatest(total, 1) THEN 20e0 * ln(x) END AS l FROM waves),
rings AS (SELECT k, bi, bj, ring, CASE WHEN count(l) = count(*) THEN avg(l) END AS m, min(ring) OVER (PARTITION BY k) AS first, max(ring) OVER (PARTITION BY k) AS last FROM levels GROUP BY k, bi, bj, ring)
SELECT k, bi, bj, round(CASE WHEN count(m) = count(*) THEN avg(m) ELSE 0e0 END, 6) AS mean, round(CASE WHEN count(m) = count(*) THEN stddev_pop(m) ELSE 0e0 END, 6) AS std
FROM rings WHERE ring > first AND ring < last GROUP BY k, bi, bj"""


def tile_states() -> str:
    """Number and sum of the values of every tile of two triggers and four bands."""
    cells, parts = TILES.step() // TILES.block, []
    for n in TILES.bands:
        parts.append(f"SELECT 'mean' AS trigger, {n} AS band, bi // {cells} AS tr, bj // {cells} AS tc, 2 AS k, mean + var AS v FROM ({mean_of(TILES, band(n))})")
        parts.append(f"SELECT 'lac', {n}, bi // {cells}, bj // {cells}, 1, lacunarity FROM (WITH {lacunarity(TILES, 'px', band(n, 31))} SELECT * FROM lac)")
    return f"SELECT trigger, band, tr, tc, 'complete' AS state, {TILES.section_size} AS section_size, CAST(sum(k) AS BIGINT) AS n, round(sum(v), 3) AS total FROM ({' UNION ALL '.join(parts)}) GROUP BY ALL"


def basic(spec: FeatureSpec) -> str:
    return f"""WITH {RASTER_E},{windows(spec, 'e')},
s AS (SELECT k, bi, bj, count(*) AS n, CAST(sum(v) AS BIGINT) AS sum, min(v) AS min, max(v) AS max, CAST(sum(v) AS DOUBLE) AS s1, CAST(sum(v * v) AS DOUBLE) AS s2 FROM p GROUP BY k, bi, bj)"""


def pyramid() -> str:
    return f"""WITH {MASK_V},{windows(V)},
lv AS (SELECT *, h // level AS ty, w // level AS tx FROM (SELECT *, unnest([2, 4, 8]) AS level FROM p)),
tiles AS (
  SELECT k, bi, bj, level, lr // ty AS i, lc // tx AS j, sum(v) AS s FROM lv WHERE ty > 1 AND tx > 1 AND lr // ty * ty < h - 1 AND least(ty, h - lr // ty * ty) > 1 AND lc // tx * tx < w - 1 AND least(tx, w - lc // tx * tx) > 1
  GROUP BY ALL)
SELECT k, bi, bj, string_agg(CAST(CAST(s AS BIGINT) AS VARCHAR), ',' ORDER BY level, i, j) AS bins FROM tiles GROUP BY k, bi, bj"""


def means_long() -> str:
    """CTEs of the long form of E's means: (k, stat, bi, bj, value)."""
    sql = mean_of(E, RASTER_E, source="e")
    head, _, tail = sql.rpartition("\nSELECT ")
    return f"{head},\nmv AS (SELECT {tail}),\nlong AS (SELECT k, 0 AS stat, bi, bj, mean AS value FROM mv UNION ALL SELECT k, 1, bi, bj, var FROM mv)"


def multi() -> str:
    """Four triggers of four bands, with their output bands: triggers in order, within them bands, scales and statistics."""
    names = {"mean": ("mean", "var"), "pantex": ("contrast",), "lac": ("lacunarity",), "grad": ("mean", "var")}
    rows, at = [], 1
    for t, own in names.items():
        for n in MULTI.bands:
            sql = {
                "mean": lambda n: mean_of(MULTI, band(n)), "pantex": lambda n: f"WITH {pantex(MULTI, 'px', band(n, 31))}\nSELECT * FROM contrast", "lac": lambda n: f"WITH {lacunarity(MULTI, 'px', band(n, 31))}\nSELECT * FROM lac",
                "grad": lambda n: mean_of(MULTI, f"{band(n)},\n{gradient('px')}", source="grad"),
            }[t](n)
            for i, name in enumerate(own):
                rows.append(f"SELECT '{t}' AS trigger, {n} AS band, k, {i} AS stat, '{name}' AS name, bi, bj, {name} AS value, CAST(CASE k WHEN 8 THEN {at + i} ELSE {at + len(own) + i} END AS INTEGER) AS out_band FROM ({sql})")
            at += 2 * len(own)
    return "\nUNION ALL\n".join(rows)


def pivoted(source: str, names: dict[str, tuple[int, str]]) -> str:
    return ", ".join(f"max(CASE WHEN k = {k} THEN {x} END) AS {n}" for n, (k, x) in names.items())


MEAN_BANDS = {f"mean_1_{k}_{i}": (k, x) for k in E.scales for i, x in enumerate(("mean", "var"))}
CONTRAST_BANDS = {f"pantex_1_{k}_0": (k, "contrast") for k in E.scales}
SUMS = f"{basic(ONE)},\nsums AS (SELECT 1 AS out_band, bi, bj, CAST(sum AS DOUBLE) AS value FROM s)"

ORACLE_SQL = {
    "scan_raster": f"WITH {RASTER_E} SELECT r, c, v FROM e",
    "select_bands": f"WITH {RASTER_L} SELECT 2 AS band, r, c, b2 AS v FROM l UNION ALL SELECT 4, r, c, b4 FROM l",
    "section_index": f"WITH {sections(E)} SELECT * FROM sections",
    "output_grid": f"WITH {RASTER_E}, {extents()},\nkinds AS (SELECT CAST(block AS BIGINT) AS block, CAST(largest AS BIGINT) AS largest FROM (SELECT unnest([1, 2, 4, 8]) AS block), (SELECT unnest([8, 16, 32]) AS largest))\nSELECT block, largest, rows, cols, {cells('rows', 'block', 'largest')} AS out_rows, {cells('cols', 'block', 'largest')} AS out_cols FROM kinds, x",
    "output_georef": f"WITH {RASTER_E}, {extents()}\nSELECT {cells('rows', '4', '8')} AS rows, {cells('cols', '4', '8')} AS cols, {CORNER[0]}e0 + 2e0 * {CORNER[2]}e0 AS left, {CORNER[1]}e0 - 2e0 * {CORNER[2]}e0 AS top, {CORNER[2]}e0 * 4 AS cell_x, {CORNER[2]}e0 * 4 AS cell_y FROM x",
    "tile_names": f"WITH {sections(E)} SELECT section, 'image__BD1_BK4_SC4-8__ST1-004__TL' || lpad(CAST(section AS VARCHAR), 6, '0') AS name FROM sections",
    "band_layout": f"{means_long()}\nSELECT bi, bj, {pivoted('mv', MEAN_BANDS)} FROM mv GROUP BY bi, bj",
    "stack_features": f"""WITH a AS (SELECT bi, bj, {pivoted('mv', MEAN_BANDS)} FROM ({mean_of(E, RASTER_E, source='e')}) GROUP BY bi, bj),
b AS (SELECT bi, bj, {pivoted('contrast', CONTRAST_BANDS)} FROM (WITH {pantex(E, 'e5', RASTER_E5)} SELECT * FROM contrast) GROUP BY bi, bj)
SELECT * FROM a FULL JOIN b USING (bi, bj)""",
    "mosaic": f"{SUMS},\ntiles AS (SELECT 0 AS tr, * FROM sums WHERE bi < 70 UNION ALL SELECT 1, out_band, bi, bj, value + 0.5e0 FROM sums WHERE bi >= 60)\nSELECT out_band, bi, bj, max_by(value, tr) AS value FROM tiles GROUP BY out_band, bi, bj",
    "overviews": f"{SUMS}\nSELECT CAST(factor AS INTEGER) AS factor, out_band, bi // factor AS bi, bj // factor AS bj, value FROM (SELECT *, unnest([2, 4, 8, 16]) AS factor FROM sums) WHERE bi % factor = 0 AND bj % factor = 0",
    "default_range": "SELECT storage, 0e0 AS image_min, CASE storage WHEN 'byte' THEN 255e0 WHEN 'uint16' THEN 10000e0 ELSE 1e0 END AS image_max FROM (VALUES ('byte'), ('uint16'), ('float32'), ('float64')) t(storage)",
    "rescale_8bit": every_band(lambda n: f"WITH {band(n)} SELECT * FROM px"),
    "rescale_5bit": every_band(lambda n: f"WITH {band(n, 31)} SELECT * FROM px"),
    "rgb_gray": f"WITH {RASTER_L} SELECT r, c, (b1 + b2 + b3) / 3e0 AS v FROM l",
    "block_percentiles": f"""WITH {RASTER_L},
px AS (SELECT 1 AS band, r, c, b1 AS v FROM l UNION ALL SELECT 2, r, c, b2 FROM l UNION ALL SELECT 3, r, c, b3 FROM l UNION ALL SELECT 4, r, c, b4 FROM l)
SELECT band, min(lo) AS p_low, max(hi) AS p_high FROM (SELECT band, quantile_cont(v, 0.01) AS lo, quantile_cont(v, 0.99) AS hi FROM px GROUP BY band, r // 32, c // 32) GROUP BY band""",
    "ndvi": index_sql("(nir - red) / nullif(nir + red, 0)"),
    "evi2": index_sql("2.5e0 * (nir - red) / nullif(nir + 2.4e0 * red + 1e0, 0)"),
    "gndvi": index_sql("(nir - green) / nullif(nir + green, 0)"),
    "grad_mean": every_band(lambda n: mean_of(L, f"{band(n)},\n{gradient('px')}", source="grad")),
    "lab_means": f"WITH {colours()} SELECT * FROM means",
    "saliency_mean": mean_of(L, saliency()),
    "smooth": smooth(),
    "equalize": f"""WITH {RASTER_E},
lim AS (SELECT min(v) AS lo, max(v) AS hi FROM e),
b AS (SELECT r, c, CASE WHEN hi = lo THEN 0 ELSE least(CAST(floor((v - lo) / ((hi - lo) / 256e0)) AS BIGINT), 255) END AS bin FROM e, lim),
n AS (SELECT bin, count(*) AS n FROM b GROUP BY bin),
u AS (SELECT bin, CAST(floor(CAST(sum(n) OVER (ORDER BY bin) AS DOUBLE) / CAST(sum(n) OVER () AS DOUBLE) * 255e0) AS BIGINT) AS v FROM n)
SELECT r, c, v FROM b JOIN u USING (bin)""",
    "gabor_mean": every_band(lambda n: " UNION ALL ".join(f"SELECT * FROM ({gabor(n, k)})" for k in BANK.scales)),
    "dmp_mean": every_band(dmp),
    "lbp_hist": pattern_histogram(),
    "lbpm_moments": pattern_moments(),
    "fourier_psd": spectrum(),
    "write_tiles": tile_states(),
    "window_mean": mean_of(E, RASTER_E, source="e"),
    "window_mean_clipped": every_band(lambda n: mean_of(L, band(n))),
    "window_mean_odd": mean_of(ODD, RASTER_E, source="e"),
    "window_basic": f"{basic(E)}\nSELECT k, bi, bj, n, sum, min, max, s1 / n AS mean, (s2 * n - s1 * s1) / n / n AS var_pop, (s2 * n - s1 * s1) / n / nullif(n - 1e0, 0) AS var_samp FROM s",
    "moments5": window_moments(),
    "pantex": f"WITH {pantex(E, 'e5', RASTER_E5)}\nSELECT * FROM contrast",
    "pantex_weighted": f"SELECT k, bi, bj, contrast * mean AS contrast FROM (WITH {pantex(E, 'e5', RASTER_E5)} SELECT * FROM contrast) JOIN ({mean_of(E, RASTER_E5, source='e5')}) USING (k, bi, bj)",
    "lacunarity": f"WITH {lacunarity(E, 'e5', RASTER_E5)}\nSELECT * FROM lac",
    "pyramid_hist": pyramid(),
    "hog_moments": hog(),
    "sfs_rays": " UNION ALL ".join(f"SELECT * FROM ({sfs(k)})" for k in LINES.scales),
    "feature_neighbors": f"""{means_long()},
a AS (SELECT *, lag(value) OVER r AS l, lead(value) OVER r AS rr, lag(value) OVER c AS t, lead(value) OVER c AS b FROM long WINDOW r AS (PARTITION BY k, stat, bi ORDER BY bj), c AS (PARTITION BY k, stat, bj ORDER BY bi))
SELECT k, stat, bi, bj, side, CASE side WHEN 'own' THEN value WHEN 'left' THEN coalesce(l, value) WHEN 'right' THEN coalesce(rr, value) WHEN 'top' THEN coalesce(t, value) ELSE coalesce(b, value) END AS value
FROM (SELECT *, unnest(['own', 'top', 'left', 'right', 'bottom']) AS side FROM a)""",
    "spatial_features": multi(),
}
