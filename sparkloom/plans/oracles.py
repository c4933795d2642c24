"""DuckDB SQL that gives the rows of the queries in ``catalogue``."""

from __future__ import annotations

B = "(2.1e0 * 0.01e0)"
CUT, MIN_R2 = "(0.01e0 * 0.01e0)", "((0.01e0 / 100) * (0.01e0 / 100))"
RANKS = 8


def _with(*parts: str) -> str:
    return "WITH RECURSIVE " + ", ".join(parts) + " "


def _round(c: str, n: int) -> str:
    return f"round({c}, {n}) + 0.0e0 AS {c.split('.')[-1]}"


# matrices
A = "a AS (SELECT vec_id AS i, CAST(k - 1 AS BIGINT) AS j, CAST(embedding[k] AS DOUBLE) AS v FROM embeddings, unnest(range(1, 65)) AS r(k))"
AA = "aa AS (SELECT l.j AS i, r.j AS j, sum(l.v * r.v) AS v FROM a l JOIN a r ON l.i = r.i GROUP BY l.j, r.j)"
AB = "ab AS (SELECT l.i, r.j, sum(l.v * r.v) AS v FROM a l JOIN aa r ON l.j = r.i GROUP BY l.i, r.j)"
_full = lambda alpha: f"SELECT coalesce(c.i, ab.i) AS i, coalesce(c.j, ab.j) AS j, round(coalesce(c.v, 0e0) + coalesce(ab.v, 0e0) * {alpha}, 6) + 0.0e0 AS v FROM a c FULL JOIN ab ON c.i = ab.i AND c.j = ab.j"

# particles
PARTICLES = (
    "l AS (SELECT sqrt(0.0005e0 * count(*)) AS size, CAST(floor(sqrt(0.0005e0 * count(*)) / " + B + ") AS BIGINT) + 1 AS dim FROM events)",
    "p AS (SELECT event_id AS id, (event_id * event_id * 7919 + event_id * 104729) % 1000003 * size / 1000003.0e0 AS x, (event_id * event_id * 15485863 + event_id * 32452843) % 999983 * size / 999983.0e0 AS y, (event_id * 48271 % 2001 - 1000) / 1000.0e0 AS vx, (event_id * 69621 % 2001 - 1000) / 1000.0e0 AS vy FROM events, l)",
)


def _cells(name: str, source: str) -> str:
    at = lambda c: f"CAST(floor({c} / {B}) AS BIGINT)"
    return f"{name} AS (SELECT *, {at('x')} AS bx, {at('y')} AS \"by\", {at('x')} * dim + {at('y')} AS cell FROM {source}, l)"


OFFSETS = "o AS (SELECT CAST(k AS INTEGER) AS dir, k // 3 - 1 AS dx, k % 3 - 1 AS dy FROM range(9) AS r(k))"


def _forces(out: str, source: str) -> tuple[str, ...]:
    """(id, ax, ay) over the 9 cells around."""
    cells = f"{source}_c"
    return (
        _cells(cells, source),
        f"{out}_n AS (SELECT s.id, s.x, s.y, t.x - s.x AS ex, t.y - s.y AS ey FROM (SELECT id, x, y, bx + dx AS bx, \"by\" + dy AS \"by\" FROM {cells}, o) s JOIN {cells} t ON s.bx = t.bx AND s.\"by\" = t.\"by\")",
        f"{out}_r AS (SELECT id, ex, ey, greatest(ex * ex + ey * ey, {MIN_R2}) AS r2 FROM {out}_n WHERE ex * ex + ey * ey <= {CUT})",
        f"{out}_s AS (SELECT id, sum((1 - 0.01e0 / sqrt(r2)) / r2 / 0.01e0 * ex) AS ax, sum((1 - 0.01e0 / sqrt(r2)) / r2 / 0.01e0 * ey) AS ay FROM {out}_r GROUP BY id)",
        f"{out} AS (SELECT {source}.*, coalesce(ax, 0e0) AS ax, coalesce(ay, 0e0) AS ay FROM {source} LEFT JOIN {out}_s USING (id))",
    )


def _moved(out: str, source: str) -> tuple[str, ...]:
    return (
        f"{out}_v AS (SELECT id, x, y, vx + ax * 0.0005e0 AS vx, vy + ay * 0.0005e0 AS vy FROM {source})",
        f"{out} AS (SELECT id, x + vx * 0.0005e0 AS x, y + vy * 0.0005e0 AS y, vx, vy FROM {out}_v)",
    )


def _reflected(out: str, source: str) -> str:
    def axis(c: str) -> str:
        rest = f"({c} - floor({c} / (2 * size)) * (2 * size))"
        place = f"CASE WHEN {c} >= 0 AND {c} <= size THEN {c} WHEN {c} < 0 AND {c} >= -size THEN -{c} WHEN {c} > size AND {c} <= 2 * size THEN 2 * size - {c} WHEN {rest} <= size THEN {rest} ELSE 2 * size - {rest} END AS {c}"
        flips = f"CAST(CASE WHEN {c} < 0 THEN ceil(-{c} / size) WHEN {c} > size THEN ceil({c} / size) - 1 ELSE 0 END AS BIGINT)"
        return f"{place}, CASE WHEN {flips} % 2 = 0 THEN v{c} ELSE -v{c} END AS v{c}"

    return f"{out} AS (SELECT id, {axis('x')}, {axis('y')} FROM {source}, l)"


def _step(out: str, source: str) -> tuple[str, ...]:
    return (*_forces(f"{out}_f", source), *_moved(f"{out}_m", f"{out}_f"), _reflected(out, f"{out}_m"))


STATE = f"SELECT id, {_round('x', 6)}, {_round('y', 6)}, {_round('vx', 4)}, {_round('vy', 4)} FROM "
FORCES = _with(*PARTICLES, OFFSETS, *_forces("f", "p")) + f"SELECT id, {_round('ax', 4)}, {_round('ay', 4)} FROM f"
BRUTE = (
    _with(*PARTICLES)
    + f", n AS (SELECT s.id, t.x - s.x AS ex, t.y - s.y AS ey FROM p s, p t WHERE (t.x - s.x) * (t.x - s.x) + (t.y - s.y) * (t.y - s.y) <= {CUT}), r AS (SELECT id, ex, ey, greatest(ex * ex + ey * ey, {MIN_R2}) AS r2 FROM n), s AS (SELECT id, sum((1 - 0.01e0 / sqrt(r2)) / r2 / 0.01e0 * ex) AS ax, sum((1 - 0.01e0 / sqrt(r2)) / r2 / 0.01e0 * ey) AS ay FROM r GROUP BY id) SELECT p.id, round(coalesce(ax, 0e0), 4) + 0.0e0 AS ax, round(coalesce(ay, 0e0), 4) + 0.0e0 AS ay FROM p LEFT JOIN s USING (id)"
)
BINNED = _with(*PARTICLES, _cells("c", "p"))
DENSE = "d AS (SELECT g.cell, count(c.id) AS n FROM (SELECT unnest(range(dim * dim)) AS cell FROM l) g LEFT JOIN c ON c.cell = g.cell GROUP BY g.cell)"
STARTS = "st AS (SELECT cell, n, CAST(sum(n) OVER (ORDER BY cell) - n AS BIGINT) AS first, CAST(sum(n) OVER (ORDER BY cell) AS BIGINT) AS last FROM d)"


def _rank(c: str) -> str:
    q, r = f"((dim * dim) // {RANKS})", f"((dim * dim) % {RANKS})"
    return f"CASE WHEN {c} < {r} * ({q} + 1) THEN {c} // ({q} + 1) ELSE {r} + ({c} - {r} * ({q} + 1)) // greatest({q}, 1) END"


FLOWN = (
    "fl AS (SELECT id, x + vx * (0.0005e0 * 10) AS x, y + vy * (0.0005e0 * 10) AS y, vx, vy FROM p)",
    _reflected("fr", "fl"),
    _cells("fc", "fr"),
    _cells("c", "p"),
    "ch0 AS (SELECT c.id, c.cell AS old_cell, fc.cell AS new_cell, fc.x, fc.y FROM c JOIN fc USING (id))",
    f"ch AS (SELECT ch0.*, {_rank('old_cell')} AS old_rank, {_rank('new_cell')} AS new_rank FROM ch0, l)",
    "ro AS (SELECT *, CASE WHEN old_cell = new_cell THEN 'stay' WHEN old_rank = new_rank THEN 'local' ELSE 'migrate' END AS route FROM ch)",
    f"sn AS (SELECT g.source, g.target, count(ro.id) AS n FROM (SELECT k // {RANKS} AS source, k % {RANKS} AS target FROM range({RANKS * RANKS}) AS r(k)) g LEFT JOIN ro ON ro.route = 'migrate' AND ro.old_rank = g.source AND ro.new_rank = g.target GROUP BY g.source, g.target)",
)
CHANGES = _with(*PARTICLES, *FLOWN)
GRID = (PARTICLES[0], OFFSETS, "g AS (SELECT cell, cell // dim AS bx, cell % dim AS \"by\", dim FROM (SELECT unnest(range(dim * dim)) AS cell, dim FROM l))", f"h0 AS (SELECT cell, (bx + dx) * dim + \"by\" + dy AS theirs, dim FROM g, o WHERE bx + dx >= 0 AND bx + dx < dim AND \"by\" + dy >= 0 AND \"by\" + dy < dim)", f"h AS (SELECT {_rank('cell')} AS rank, {_rank('theirs')} AS other, cell, theirs FROM h0)")

# k-mers
_digest = lambda t: f"translate(md5({t}), '0123456789abcdef', 'ACGTACGTACGTACGT')"


def _kmers(k: int) -> str:
    q = _digest("CAST(o_orderkey AS VARCHAR)") + ("" if k + 13 <= 32 else " || " + _digest("'a' || CAST(o_orderkey AS VARCHAR)"))
    return f"km AS (SELECT substr(q, p, {k}) AS kmer, CASE WHEN p = 1 THEN 'F' ELSE substr(q, p - 1, 1) END AS b_ext, CASE WHEN p = 14 THEN 'F' ELSE substr(q, p + {k}, 1) END AS f_ext, o_orderkey * 14 + p - 1 AS line_no FROM (SELECT o_orderkey, {q} AS q FROM orders) s, range(1, 15) AS r(p))"


def _byte(n: int, k: int) -> str:
    code = lambda i: f"(instr('ACGT', substr(kmer, {i + 1}, 1)) - 1)" if i < k else "0"
    return f"(64 * {code(4 * n)} + 16 * {code(4 * n + 1)} + 4 * {code(4 * n + 2)} + {code(4 * n + 3)})"


def _hash(k: int) -> str:
    h = "CAST(5381 AS BIGINT)" if k <= 32 else "CAST(5381 AS HUGEINT)"
    for n in range(-(-k // 4)):
        h = f"({h} * 33 + {_byte(n, k)})" if k <= 32 else f"(({h} * 33 + {_byte(n, k)}) % CAST(18446744073709551616 AS HUGEINT))"
    return h


def _walk(k: int, short: str = "true", kept: str = "true") -> str:
    """Walks forwards from the starts over one row a k-mer."""
    km = _kmers(k).replace("km AS (SELECT ", "km AS (SELECT * FROM (SELECT ", 1) + f" WHERE {kept})"
    return _with(km, "nd AS MATERIALIZED (SELECT kmer, min(f_ext) AS f_ext FROM km GROUP BY kmer)", f"w AS (SELECT kmer AS contig, f_ext, CAST(1 AS BIGINT) AS n_nodes, substr(kmer, 2) || f_ext AS nx FROM (SELECT DISTINCT kmer, f_ext FROM km WHERE b_ext = 'F') UNION ALL SELECT w.contig || w.f_ext, nd.f_ext, w.n_nodes + 1, substr(nd.kmer, 2) || nd.f_ext FROM w JOIN nd ON nd.kmer = w.nx WHERE w.f_ext <> 'F' AND {short})")


KM = _with(_kmers(19))
H19 = _hash(19)


def _packed_bytes(k: int) -> str:
    return " || ".join(f"substr('0123456789ABCDEF', {b} // 16 + 1, 1) || substr('0123456789ABCDEF', {b} % 16 + 1, 1)" for b in (_byte(n, k) for n in range(-(-k // 4))))


_packed = _packed_bytes(19)

SQL: dict[str, str] = {
    "dgemm_coo": _with(A, AA) + "SELECT i, j, round(v, 6) + 0.0e0 AS v FROM aa",
    "dgemm_blocked": _with(A, AA) + "SELECT i, j, round(v, 6) + 0.0e0 AS v FROM aa",
    "dgemm_accumulate": _with(A, AA, AB) + _full("1e0"),
    "dgemm_alpha": _with(A, AA, AB) + _full("(-2.5e0)"),
    "dgemm_twolevel": _with(A) + "SELECT l.i, r.i AS j, round(sum(l.v * r.v), 6) + 0.0e0 AS v FROM a l JOIN a r ON l.j = r.j GROUP BY l.i, r.i",
    "dgemm_verify": _with(A, AA, "parts AS (SELECT l.j AS i, r.j AS j, sum(l.v * r.v) AS v, sum(abs(l.v) * abs(r.v)) AS size FROM a l JOIN a r ON l.i = r.i GROUP BY l.j, r.j, l.i // 16)", "s AS (SELECT i, j, sum(v) AS other, sum(size) AS size FROM parts GROUP BY i, j)", "bad AS (SELECT abs(v - other) > 3 * 2.220446049250313e-16 * (SELECT count(*) FROM embeddings) * size AS far FROM aa JOIN s USING (i, j))") + "SELECT count(*) AS n_cells, CAST(coalesce(sum(far::INT), 0) AS BIGINT) AS n_violations, coalesce(sum(far::INT), 0) = 0 AS ok FROM bad",
    "bench_summary": "WITH t AS (SELECT CAST(l_linenumber * 32 AS BIGINT) AS n, count(*) AS iterations, sum(l_quantity) / 1e6 AS seconds FROM lineitem GROUP BY l_linenumber), g AS (SELECT 2e-9 * iterations * n * n * n / seconds AS gflops FROM t) SELECT round(avg(gflops), 6) + 0.0e0 AS gflops, round(avg(gflops * 100 / 56e0), 6) + 0.0e0 AS percent FROM g",
    "particle_lattice": "WITH n AS (SELECT count(*) AS n, CAST(ceil(sqrt(count(*))) AS BIGINT) AS sx, sqrt(0.0005e0 * count(*)) AS size FROM orders), m AS (SELECT *, CAST(ceil(n / CAST(sx AS DOUBLE)) AS BIGINT) AS sy FROM n), q AS (SELECT i + 1 AS id, i * 7919 % n AS k, sx, sy, size FROM (SELECT unnest(range(n)) AS i, * FROM m)) SELECT id, round(size * (1.0e0 + k % sx) / (1.0e0 + sx), 9) + 0.0e0 AS x, round(size * (1.0e0 + k // sx) / (1.0e0 + sy), 9) + 0.0e0 AS y, round((id * 48271 + 1) % 2001 / 1000.0e0 - 1.0e0, 6) + 0.0e0 AS vx, round((id * 69621 + 1) % 2001 / 1000.0e0 - 1.0e0, 6) + 0.0e0 AS vy FROM q",
    "cell_assign": BINNED + "SELECT id, bx, \"by\", cell FROM c",
    "cell_neighbors": _with(*PARTICLES, _cells("c", "p"), OFFSETS) + "SELECT cell, dir, (bx + dx) * dim + \"by\" + dy AS neighbour FROM (SELECT DISTINCT cell, bx, \"by\", dim FROM c), o WHERE bx + dx >= 0 AND bx + dx < dim AND \"by\" + dy >= 0 AND \"by\" + dy < dim",
    "force_bruteforce": BRUTE,
    "force_binned": FORCES,
    "force_halfstencil": FORCES,
    "force_dense": _with(*PARTICLES, f"pd AS (SELECT id, CASE WHEN id % 4 = 0 THEN x * ({B} / size) ELSE x END AS x, CASE WHEN id % 4 = 0 THEN y * ({B} / size) ELSE y END AS y FROM p, l)", OFFSETS, *_forces("f", "pd")) + f"SELECT id, {_round('ax', 2)}, {_round('ay', 2)} FROM f",
    "force_equiv": _with(*PARTICLES, OFFSETS, *_forces("f", "p"), f"q AS (SELECT s.id, t.id AS nid, t.x - s.x AS ex, t.y - s.y AS ey FROM (SELECT id, x, y, bx + dx AS bx, \"by\" + dy AS \"by\" FROM p_c, o WHERE dir >= 4) s JOIN p_c t ON s.bx = t.bx AND s.\"by\" = t.\"by\" AND (s.id < t.id OR s.bx <> floor(s.x / {B}) OR s.\"by\" <> floor(s.y / {B})))", f"h AS (SELECT id, nid, (1 - 0.01e0 / sqrt(greatest(ex * ex + ey * ey, {MIN_R2}))) / greatest(ex * ex + ey * ey, {MIN_R2}) / 0.01e0 * ex AS fx, (1 - 0.01e0 / sqrt(greatest(ex * ex + ey * ey, {MIN_R2}))) / greatest(ex * ex + ey * ey, {MIN_R2}) / 0.01e0 * ey AS fy FROM q WHERE ex * ex + ey * ey <= {CUT})", "hs AS (SELECT id, sum(fx) AS hx, sum(fy) AS hy FROM (SELECT id, fx, fy FROM h UNION ALL SELECT nid, -fx, -fy FROM h) GROUP BY id)") + "SELECT count(*) AS n_particles, CAST(coalesce(sum(CAST(abs(ax - coalesce(hx, 0e0)) > 1e-9 * greatest(1e0, abs(ax)) OR abs(ay - coalesce(hy, 0e0)) > 1e-9 * greatest(1e0, abs(ay)) AS INTEGER)), 0) AS BIGINT) AS n_different FROM f LEFT JOIN hs USING (id)",
    "particle_move": _with(*PARTICLES, OFFSETS, *_forces("f", "p"), *_moved("m", "f")) + STATE + "m",
    "particle_bounce": _with(*PARTICLES, "t AS (SELECT id, x + vx * (3.3e0 * size) AS x, y + vy * (3.3e0 * size) AS y, vx, vy FROM p, l)", _reflected("b", "t")) + STATE + "b",
    "particle_step": _with(*PARTICLES, OFFSETS, *_step("s1", "p")) + STATE + "s1",
    "sim_two_steps": _with(*PARTICLES, OFFSETS, *_step("s1", "p"), *_step("s2", "s1")) + STATE + "s2",
    "sim_frames": _with(*PARTICLES, OFFSETS, *_step("s1", "p"), *_step("s2", "s1")) + f"SELECT 0 AS frame, id, {_round('x', 6)}, {_round('y', 6)} FROM s1 UNION ALL SELECT 1, id, {_round('x', 6)}, {_round('y', 6)} FROM s2",
    "bin_count": _with(*PARTICLES, _cells("c", "p"), DENSE) + "SELECT cell, n FROM d",
    "bin_prefix_sum": _with(*PARTICLES, _cells("c", "p"), DENSE, STARTS) + "SELECT * FROM st",
    "bin_scatter": _with(*PARTICLES, _cells("c", "p"), DENSE, STARTS) + "SELECT id, cell, first + row_number() OVER (PARTITION BY cell ORDER BY id) - 1 AS slot FROM c JOIN st USING (cell)",
    "orders_running": "SELECT o_orderkey, o_custkey % 10 AS n, CAST(sum(o_custkey % 10) OVER w - o_custkey % 10 AS BIGINT) AS before, CAST(sum(o_custkey % 10) OVER w AS BIGINT) AS upto FROM orders WINDOW w AS (ORDER BY o_totalprice, o_orderkey)",
    "bin_linked_list": BINNED + "SELECT id, cell, lag(id) OVER (PARTITION BY cell ORDER BY id) AS next, id = max(id) OVER (PARTITION BY cell) AS head FROM c",
    "bin_members": BINNED + "SELECT cell, count(*) AS n, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS members FROM c GROUP BY cell",
    "cell_changes": CHANGES + "SELECT id, old_cell, new_cell FROM ch WHERE old_cell <> new_cell",
    "bins_streamed": CHANGES + "SELECT new_cell AS cell, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids FROM ch WHERE id % 7 <> 0 GROUP BY new_cell",
    "kmers_by_sql": _with(_kmers(51)) + f"SELECT kmer, {_packed_bytes(51)} AS packed, kmer AS unpacked, CAST({_hash(51)} AS VARCHAR) AS hash, CASE WHEN f_ext <> 'F' THEN substr(kmer, 2) || f_ext END AS next, CASE WHEN b_ext <> 'F' THEN b_ext || substr(kmer, 1, 50) END AS prev FROM km",
    "stencil_by_sql": _with(*PARTICLES, _cells("c", "p"), OFFSETS) + "SELECT cell, dir, (bx + dx) * dim + \"by\" + dy AS neighbour FROM (SELECT DISTINCT cell, bx, \"by\", dim FROM c), o WHERE bx + dx >= 0 AND bx + dx < dim AND \"by\" + dy >= 0 AND \"by\" + dy < dim",
    "rank_assign": BINNED + f"SELECT id, cell, {_rank('cell')} AS rank FROM c",
    "rank_assign_strip": BINNED + f"SELECT id, bx, least(bx // (dim // {RANKS}), {RANKS - 1}) AS rank, CASE WHEN bx - dim // {RANKS} >= -1 AND bx - dim // {RANKS} <= dim // {RANKS} THEN bx - dim // {RANKS} + 1 WHEN bx - dim // {RANKS} < -1 THEN -2 ELSE -3 END AS place FROM c",
    "halo_send": _with(*GRID) + "SELECT DISTINCT rank, other, cell FROM h WHERE rank <> other",
    "halo_recv": _with(*GRID) + "SELECT DISTINCT rank, other, theirs AS cell FROM h WHERE rank <> other",
    "migration_route": CHANGES + "SELECT id, old_cell, new_cell, old_rank, new_rank, route FROM ro",
    "migration_matrix": CHANGES + "SELECT source, target, n FROM sn",
    "send_displacements": CHANGES + "SELECT source, target, n, CAST(coalesce(sum(n) OVER (PARTITION BY source ORDER BY target ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS displ FROM sn",
    "migration_apply": CHANGES + "SELECT CASE WHEN route = 'migrate' THEN new_rank ELSE old_rank END AS rank, id, new_cell AS cell FROM ro",
    "gather_ordered": CHANGES + f"SELECT id, {_round('x', 6)}, {_round('y', 6)} FROM ch ORDER BY id",
    "kmer_size": "SELECT CAST(19 AS INTEGER) AS k",
    "kmer_count": KM + "SELECT count(*) AS n FROM km",
    "kmer_parse": KM + "SELECT kmer, b_ext, f_ext, kmer || ' ' || b_ext || f_ext AS shown FROM km",
    "kmer_file": KM + "SELECT kmer, b_ext, f_ext, kmer || ' ' || b_ext || f_ext AS shown FROM km",
    "kmer_file_stats": KM + "SELECT CAST(19 AS INTEGER) AS k, count(*) AS n_lines, count(*) AS n_kmers FROM km",
    "contig_file": _walk(19) + "SELECT contig FROM w WHERE f_ext = 'F'",
    "trajectory_file": _with(*PARTICLES, *FLOWN[:5]) + "SELECT CAST(frame AS BIGINT) AS frame, row_number() OVER (PARTITION BY frame ORDER BY id) - 1 AS nth, CAST(format('{:.6g}', x) AS DOUBLE) AS x, CAST(format('{:.6g}', y) AS DOUBLE) AS y FROM (SELECT 0 AS frame, id, x, y FROM p UNION ALL SELECT 1, id, x, y FROM ch0)",
    "kmer_block_split": KM + f"SELECT line_no // m AS rank, count(*) AS n, min(line_no) AS first_line FROM km, (SELECT (count(*) + {RANKS - 1}) // {RANKS} AS m FROM km) GROUP BY line_no // m",
    "kmer_validate": KM + "SELECT reason, count(*) AS n FROM (SELECT CASE WHEN line_no % 97 = 0 THEN 'letter' WHEN line_no % 89 = 0 THEN 'length' END AS reason FROM km) WHERE reason IS NOT NULL GROUP BY reason",
    "kmer_reject_counts": KM + "SELECT CASE WHEN line_no % 97 = 0 THEN 'letter' WHEN line_no % 89 = 0 THEN 'length' ELSE 'valid' END AS reason, count(*) AS n FROM km GROUP BY 1",
    "kmer_pack": KM + f"SELECT kmer, {_packed} AS packed FROM km",
    "kmer_unpack": KM + "SELECT kmer, kmer AS unpacked FROM km",
    "kmer_hash": KM + f"SELECT kmer, {H19} AS hash FROM km",
    "kmer_hash_51": _with(_kmers(51)) + f"SELECT kmer, CAST({_hash(51)} AS VARCHAR) AS hash FROM km",
    "kmer_partition": KM + f"SELECT kmer, {H19} % {RANKS} AS rank, ({H19} >> 3) % 1024 AS bucket FROM km",
    "kmer_slots": KM + f"SELECT kmer, slot, slot // share AS rank, slot % share AS local FROM (SELECT kmer, {H19} % slots AS slot, share FROM km, (SELECT 2 * count(*) AS slots, (2 * count(*) + {RANKS - 1}) // {RANKS} AS share FROM km))",
    "kmer_next": KM + "SELECT kmer, substr(kmer, 2) || f_ext AS next FROM km WHERE f_ext <> 'F'",
    "kmer_prev": KM + "SELECT kmer, b_ext || substr(kmer, 1, 18) AS prev FROM km WHERE b_ext <> 'F'",
    "kmer_lookup": KM + ", a AS MATERIALIZED (SELECT kmer, substr(kmer, 2) || f_ext AS next FROM km WHERE f_ext <> 'F'), b AS MATERIALIZED (SELECT kmer AS own, f_ext AS next_f FROM km) SELECT a.kmer, a.next, b.next_f FROM a LEFT JOIN b ON b.own = a.next",
    "kmer_next_two": KM + ", b AS MATERIALIZED (SELECT kmer, f_ext, CASE WHEN f_ext <> 'F' THEN substr(kmer, 2) || f_ext END AS next FROM km) SELECT b.kmer, b.next, c.f_ext AS next_f, c.next AS second, d.f_ext AS second_f FROM b LEFT JOIN b c ON c.kmer = b.next LEFT JOIN b d ON d.kmer = c.next",
    "kmer_repeated": _with(_kmers(7)) + "SELECT kmer, count(*) AS n FROM km GROUP BY kmer HAVING count(*) > 1",
    "start_nodes": KM + "SELECT kmer, b_ext, f_ext FROM km WHERE b_ext = 'F'",
    "end_nodes": KM + "SELECT kmer, b_ext, f_ext FROM km WHERE f_ext = 'F'",
    "dangling_edges": KM + ", kept AS (SELECT * FROM km WHERE line_no % 700 <> 6) SELECT a.kmer, substr(a.kmer, 2) || a.f_ext AS next FROM kept a WHERE a.f_ext <> 'F' AND NOT EXISTS (SELECT 1 FROM kept b WHERE b.kmer = substr(a.kmer, 2) || a.f_ext)",
    "contigs": _walk(19) + "SELECT contig, n_nodes FROM w WHERE f_ext = 'F'",
    "contigs_51": _walk(51) + "SELECT contig, n_nodes FROM w WHERE f_ext = 'F'",
    "contigs_merging": _walk(11, "n_nodes < 5000") + "SELECT contig, n_nodes FROM w WHERE f_ext = 'F'",
    "contig_chunks": _walk(51) + "SELECT substr(contig, 1, 51) AS start, n_nodes, c AS chunk, substr(contig, c * 52 + 1, 52) AS text FROM w, range(100) AS r(c) WHERE f_ext = 'F' AND c * 52 < length(contig)",
    "broken_walks": _walk(19, "true", "line_no % 700 <> 6") + "SELECT contig || f_ext AS contig, n_nodes, nx AS next FROM w WHERE f_ext <> 'F' AND NOT EXISTS (SELECT 1 FROM nd WHERE nd.kmer = w.nx)",
    "assembly_stats": _walk(19) + "SELECT count(*) AS n_contigs, CAST(sum(n_nodes) AS BIGINT) AS n_nodes FROM w WHERE f_ext = 'F'",
}
