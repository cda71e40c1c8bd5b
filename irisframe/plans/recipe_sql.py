"""The image recipes as SQL: every step is a relation of pixels (vec_id, y, x, c, v)."""

from __future__ import annotations

from collections.abc import Callable

_LEVEL = "least(greatest(floor({} * 48 + 128), 0), 255)"
_START = f"""e AS (SELECT vec_id, embedding AS e, unnest(range(64))::int AS p FROM embeddings),
s AS (SELECT vec_id, p // 8 AS y, p % 8 AS x, unnest(range(3))::int AS c, e, p FROM e),
p0 AS (SELECT vec_id, y, x, c, CASE c WHEN 0 THEN {_LEVEL.format("e[p + 1]::double")}
  WHEN 1 THEN {_LEVEL.format("e[64 - p]::double")} ELSE {_LEVEL.format("(-e[p + 1]::double)")} END AS v FROM s)"""

Step = Callable[[str, int], str]


def _draw(step: int, name: str, k: int) -> str:
    digest = f"md5('42:1:' || vec_id || ':{step}.{name}.{k}')"
    return f"(('0x' || substr({digest}, 1, 15))::bigint / {float(1 << 60)!r}::double)"


def resize(n_in: int, n_out: int, antialias: bool = False) -> Step:
    scale, reach = f"({n_in}::double / {n_out})", f"{max(n_in / n_out, 1.0) if antialias else 1.0!r}::double"
    centre = f"((o + 0.5::double) * {scale} - 0.5)"
    if not antialias:
        centre = f"greatest(least({centre}, {n_in - 1}), 0)"
    weights = f"SELECT o, i, greatest(0, 1 - abs(i - {centre}) / {reach}) AS w FROM range({n_out}) a(o), range({n_in}) b(i)"
    ready = f"(SELECT o, i, w / sum(w) OVER (PARTITION BY o) AS w FROM ({weights}) WHERE w > 0)"
    return lambda p, k: (
        f"SELECT vec_id, a.o AS y, b.o AS x, c, sum(a.w * b.w * v) AS v FROM {p} JOIN {ready} a ON a.i = y "
        f"JOIN {ready} b ON b.i = x GROUP BY ALL"
    )


def flip(axis: str, size: int, chance: float) -> Step:
    name = {"x": "flip_horizontal", "y": "flip_vertical"}[axis]

    def sql(p: str, k: int) -> str:
        moved = f"CASE WHEN {_draw(k, name, 0)} < {chance} THEN {size - 1} - {axis} ELSE {axis} END AS {axis}"
        return f"SELECT vec_id, {moved}, {'y' if axis == 'x' else 'x'}, c, v FROM {p}"

    return sql


def crop(n_in: int, size: int) -> Step:
    def sql(p: str, k: int) -> str:
        top, left = (f"floor({_draw(k, 'random_crop', i)} * {n_in - size + 1})::int" for i in range(2))
        return f"SELECT * FROM (SELECT vec_id, y - {top} AS y, x - {left} AS x, c, v FROM {p}) WHERE least(y, x) >= 0 AND greatest(y, x) < {size}"

    return sql


def _mirrored(i: str, n: int) -> str:
    m = f"(abs({i}) % {2 * n - 2})"
    return f"CASE WHEN {m} < {n} THEN {m} ELSE {2 * n - 2} - {m} END"


def _warp(size: int, setup: str, sx: str, sy: str, border: str, nearest: bool, go: str) -> Callable[[str], str]:
    """``sx`` and ``sy`` give the source, measured from the centre, of (dx, dy)."""
    mid = (size - 1) / 2
    place = (lambda s: f"floor({s} + {mid} + 0.5)") if nearest else (lambda s: f"{s} + {mid}")

    def sql(p: str) -> str:
        at = f"SELECT *, y - {mid}::double AS dy, x - {mid}::double AS dx, {setup}, {go} AS go FROM (SELECT DISTINCT vec_id, y, x FROM {p})"
        source = f"SELECT vec_id, y, x, go, {place(sx)} AS sx, {place(sy)} AS sy FROM ({at})"
        corner = f"SELECT *, floor(sx)::int AS x0, floor(sy)::int AS y0 FROM ({source})"
        four = (
            f"SELECT vec_id, y, x, yy, xx, (1 - abs(sy - yy)) * (1 - abs(sx - xx)) AS w FROM "
            f"(SELECT *, y0 + i AS yy, x0 + j AS xx FROM ({corner}), range(2) a(i), range(2) b(j)) WHERE go"
        )
        if border == "reflect":
            four = f"SELECT vec_id, y, x, {_mirrored('yy', size)} AS yy, {_mirrored('xx', size)} AS xx, w FROM ({four})"
        warped = f"SELECT f.vec_id, f.y, f.x, f.yy, f.xx, w, c FROM ({four}) f, range(3) d(c)"
        value = f"SELECT f.vec_id, f.y, f.x, f.c, sum(w * coalesce(q.v, 0)) AS v FROM ({warped}) f LEFT JOIN {p} q ON q.vec_id = f.vec_id AND q.y = yy AND q.x = xx AND q.c = f.c GROUP BY ALL"
        still = f"SELECT p.vec_id, p.y, p.x, p.c, p.v FROM {p} p WHERE NOT ({go})"
        return f"{value} UNION ALL {still}"

    return sql


def rotate(size: int, limit: int, chance: float = 1.0, border: str = "reflect", nearest: bool = False) -> Step:
    def sql(p: str, k: int) -> str:
        setup = f"radians(({_draw(k, 'rotate', 0)} * 2 - 1) * {limit}) AS ang"
        go = f"{_draw(k, 'rotate', 1)} < {chance}" if chance < 1 else "true"
        return _warp(size, setup, "(cos(ang) * dx - sin(ang) * dy)", "(sin(ang) * dx + cos(ang) * dy)", border, nearest, go)(p)

    return sql


def shift_scale_rotate(size: int, chance: float = 0.5) -> Step:
    def sql(p: str, k: int) -> str:
        u = [f"({_draw(k, 'shift_scale_rotate', i)} * 2 - 1)" for i in range(4)]
        setup = f"radians({u[0]} * 10) AS ang, 1 + {u[1]} * 0.05::double AS sc, {u[2]} * 0.05::double * {size} AS mx, {u[3]} * 0.05::double * {size} AS my"
        go = f"{_draw(k, 'shift_scale_rotate', 4)} < {chance}"
        sx, sy = "(cos(ang) * (dx - mx) - sin(ang) * (dy - my)) / sc", "(sin(ang) * (dx - mx) + cos(ang) * (dy - my)) / sc"
        return _warp(size, setup, f"({sx})", f"({sy})", "zero", False, go)(p)

    return sql


def brightness(chance: float = 0.5) -> Step:
    def sql(p: str, k: int) -> str:
        contrast, bright = (f"({_draw(k, 'brightness_contrast', i)} * 2 - 1) * 0.1::double" for i in range(2))
        new = f"least(greatest(v * (1 + {contrast}) + {bright} * 255, 0), 255)"
        return f"SELECT vec_id, y, x, c, CASE WHEN {_draw(k, 'brightness_contrast', 2)} < {chance} THEN {new} ELSE v END AS v FROM {p}"

    return sql


def blur(size: int, chance: float = 0.2) -> Step:
    def sql(p: str, k: int) -> str:
        go = f"{_draw(k, 'gaussian_blur', 0)} < {chance}"
        near = "(VALUES (-1, 0.25::double), (0, 0.5::double), (1, 0.25::double))"
        spread = f"SELECT vec_id, y, x, c, a.w * b.w AS w, {_mirrored('(y + a.i)', size)} AS yy, {_mirrored('(x + b.i)', size)} AS xx FROM {p}, {near} a(i, w), {near} b(i, w) WHERE {go}"
        value = f"SELECT f.vec_id, f.y, f.x, f.c, sum(w * q.v) AS v FROM ({spread}) f JOIN {p} q ON q.vec_id = f.vec_id AND q.y = yy AND q.x = xx AND q.c = f.c GROUP BY ALL"
        return f"{value} UNION ALL SELECT vec_id, y, x, c, v FROM {p} WHERE NOT ({go})"

    return sql


def recipe(steps: list[Step], size: int, mean: tuple[float, ...], std: tuple[float, ...], rounded: bool = False) -> str:
    """All steps, then normalised and channel first, one row a value."""
    parts, p = [_START], "p0"
    for k, step in enumerate(steps):
        # A relation that is used more than once is computed once, so that its draws
        # and sums are the same everywhere.
        body = step(p, k)
        if rounded:
            body = f"SELECT vec_id, y, x, c, least(greatest(floor(v + 0.5::double), 0), 255) AS v FROM ({body})"
        p = f"p{k + 1}"
        parts.append(f"{p} AS MATERIALIZED ({body})")
    pick = lambda values: "CASE c " + " ".join(f"WHEN {i} THEN {v}::double" for i, v in enumerate(values)) + " END"
    value = f"round((v / 255 - {pick(mean)}) / {pick(std)}, 6) + 0"
    return f"WITH {', '.join(parts)} SELECT vec_id, (c * {size * size} + y * {size} + x)::int AS pos, {value} AS value FROM {p}"


_NET, _HALF = ((0.485, 0.456, 0.406), (0.229, 0.224, 0.225)), ((0.5,) * 3, (0.5,) * 3)
_TRAIN = [resize(8, 8), flip("x", 8, 0.5), flip("y", 8, 0.2), rotate(8, 15, 0.5), brightness(), shift_scale_rotate(8), blur(8)]

_UNIT = "u AS (SELECT vec_id, list(v / 200 ORDER BY y, x, c) AS px FROM p0 GROUP BY vec_id)"


def _bytes(v: str) -> str:
    byte = f"printf('%02X', least(greatest(floor({v} * 255 + 0.5::double), 0), 255)::int)"
    return f"array_to_string(list_transform(px, lambda z: {byte}), '')"


RECIPES = {
    "recipe_valid": recipe([resize(8, 6)], 6, *_NET),
    "recipe_train": recipe(_TRAIN, 8, *_NET),
    "recipe_train_eight_bit": recipe(_TRAIN, 8, *_NET, rounded=True),
    "recipe_translation": recipe([resize(8, 35, True), crop(35, 5), flip("x", 5, 0.5)], 5, *_HALF),
    "recipe_two_stream": recipe([resize(8, 5, True), flip("x", 5, 0.5), rotate(5, 10, 1.0, "zero", True)], 5, *_NET),
    "image_bytes_stretched": f"WITH {_START}, {_UNIT} SELECT vec_id, {_bytes('z')} AS plain, "
    f"{_bytes('((z - list_min(px)) / greatest(list_max(px) - list_min(px), 0.00001::double))')} AS stretched FROM u",
}
