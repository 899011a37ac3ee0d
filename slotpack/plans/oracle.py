"""DuckDB oracle SQL for the named queries (independent formulations, not the Spark plans).

The stand-in corpus is rebuilt from ``lineitem`` / ``orders`` / ``part`` with the same fixed
mapping as ``slotpack.sources.standin``; sequential placement and next-fit are recursive CTEs over
positions; exact packing tabulates the least number of slots of every multiset of at most 20 items
once and then takes the largest subset mask whose rest still packs optimally, slot after slot;
first-fit decreasing is an item-by-item recursion.
"""

from __future__ import annotations

from slotpack.sources.standin import FILE_HEADER_CARET, FILE_HEADER_FIXED, FILE_PRELUDE, STRUCT_TYPE_ID, TYPE_LIST

SORT = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice"
_CORPUS_SQL = {
    "order": ("'O'", "l_orderkey"),
    "part": ("'P'", "l_partkey"),
}


def _tl() -> str:
    rows = ", ".join(f"({i}, '{t[0]}', '{t[1]}', {t[2]}, '{t[3]}')" for i, t in enumerate(TYPE_LIST))
    return f"TL(code, type_id, type_label, nbytes, encoding) AS (VALUES {rows})"


def _vars(corpora) -> str:
    parts = []
    for c in corpora:
        prefix, key = _CORPUS_SQL[c]
        parts.append(
            f"SELECT {prefix} || CAST({key} AS VARCHAR) AS contract_id, "
            f"CAST(row_number() OVER (PARTITION BY {key} ORDER BY {SORT}) - 1 AS INTEGER) AS ordinal, "
            f"CAST(l_quantity AS INTEGER) % 10 AS code, CAST((l_linenumber + l_suppkey) % 9 AS INTEGER) AS mcode "
            f"FROM lineitem")
    return "V AS (" + " UNION ALL ".join(parts) + ")"


#: Part of a file's name that cuts the orders of one customer into files, and the queries that take them whole.
_BY_THOUSAND = " || '-' || CAST(o_orderkey // 1000 AS VARCHAR)"
WHOLE_FILES = ("savings_preview", "external_types", "normalized_source", "examples", "contract_sources")


def _contracts(corpora) -> str:
    parts = []
    if "order" in corpora:
        parts.append("SELECT CASE WHEN o_orderstatus = 'P' THEN 'pending/' ELSE 'real/' END || 'c' || "
                     f"CAST(o_custkey AS VARCHAR){_BY_THOUSAND} || '.sol' AS file, 'Order' || CAST(o_orderkey AS VARCHAR) AS contract_name, "
                     "'O' || CAST(o_orderkey AS VARCHAR) AS contract_id, o_orderkey AS k FROM orders")
    if "part" in corpora:
        parts.append("SELECT 'synthetic/' || replace(p_brand, '#', '_') || '-' || CAST(p_partkey // 100 AS VARCHAR) || '.sol' AS file, "
                     "'Part' || CAST(p_partkey AS VARCHAR) AS contract_name, "
                     "'P' || CAST(p_partkey AS VARCHAR) AS contract_id, p_partkey AS k FROM part")
    return ("C0 AS (" + " UNION ALL ".join(parts) + "), "
            "C AS (SELECT file, contract_name, contract_id, "
            "CAST(row_number() OVER (PARTITION BY file ORDER BY k) - 1 AS INTEGER) AS contract_ord FROM C0)")


# sequential placement (declared layout and next-fit share it)
def _slot(s, u, b):
    return f"(CASE WHEN {b} >= 32 THEN {s} + (CASE WHEN {u} > 0 THEN 1 ELSE 0 END) WHEN {u} + {b} > 32 THEN {s} + 1 ELSE {s} END)"


def _off(u, b):
    return f"(CASE WHEN {b} >= 32 THEN 0 WHEN {u} + {b} > 32 THEN 0 ELSE {u} END)"


def _ns(s, u, b):
    return (f"(CASE WHEN {b} >= 32 THEN {s} + (CASE WHEN {u} > 0 THEN 1 ELSE 0 END) + ({b} + 31) // 32 "
            f"WHEN {u} + {b} >= 32 THEN {s} + 1 ELSE {s} END)")


def _nu(u, b):
    return f"(CASE WHEN {b} >= 32 THEN 0 WHEN {u} + {b} > 32 THEN {b} WHEN {u} + {b} = 32 THEN 0 ELSE {u} + {b} END)"


def _nw(w, u, b):
    return (f"(CASE WHEN {b} >= 32 THEN {w} + (CASE WHEN {u} > 0 THEN 32 - {u} ELSE 0 END) "
            f"+ (CASE WHEN {b} % 32 <> 0 THEN 32 - {b} % 32 ELSE 0 END) "
            f"WHEN {u} + {b} > 32 THEN {w} + 32 - {u} ELSE {w} END)")


def _positions(name: str, src: str) -> str:
    """Recursive placement over ``src`` (contract_id, ordinal, number_of_bytes)."""
    return (
        f"{name}(contract_id, ordinal, s, u, slot, off) AS ("
        f"SELECT contract_id, ordinal, {_ns('0', '0', 'number_of_bytes')}, {_nu('0', 'number_of_bytes')}, "
        f"{_slot('0', '0', 'number_of_bytes')}, {_off('0', 'number_of_bytes')} FROM {src} WHERE ordinal = 0 "
        f"UNION ALL SELECT e.contract_id, e.ordinal, {_ns('p.s', 'p.u', 'e.number_of_bytes')}, "
        f"{_nu('p.u', 'e.number_of_bytes')}, {_slot('p.s', 'p.u', 'e.number_of_bytes')}, "
        f"{_off('p.u', 'e.number_of_bytes')} FROM {name} p JOIN {src} e "
        f"ON e.contract_id = p.contract_id AND e.ordinal = p.ordinal + 1)"
    )


def base(corpora, fields: bool = True) -> list[str]:
    cls = ("CASE WHEN lower({a}.encoding) <> 'inplace' THEN 'dynamic' WHEN {a}.number_of_bytes >= 32 THEN 'full' "
           "ELSE 'packable' END AS cls")
    return [
        _tl(), _vars(corpora), _contracts(corpora),
        f"F0 AS (SELECT v.contract_id, '{STRUCT_TYPE_ID}' AS type_id, v.ordinal, 'f' || CAST(v.ordinal AS VARCHAR) AS label, "
        "t.type_id AS member_type_id, t.type_label, t.nbytes AS number_of_bytes, t.encoding "
        "FROM V v JOIN TL t ON t.code = v.mcode)",
        _positions("FPOS", "F0"),
        "FL AS (SELECT f.*, CAST(p.slot AS INTEGER) AS slot, CAST(p.off AS INTEGER) AS \"offset\", "
        + cls.format(a="f") + " FROM F0 f JOIN FPOS p USING (contract_id, ordinal))",
        "ST AS (SELECT contract_id, type_id, CAST(32 * max(slot + CASE WHEN number_of_bytes <= 0 THEN 1 "
        "ELSE (number_of_bytes + 31) // 32 END) AS INTEGER) AS number_of_bytes FROM FL GROUP BY 1, 2)",
        "E0 AS (SELECT v.contract_id, v.ordinal, 'v' || CAST(v.ordinal AS VARCHAR) AS label, t.type_id, "
        f"t.type_label, CAST(CASE WHEN t.type_id = '{STRUCT_TYPE_ID}' THEN st.number_of_bytes ELSE t.nbytes END AS INTEGER) "
        "AS number_of_bytes, t.encoding FROM V v JOIN TL t ON t.code = v.code "
        "LEFT JOIN ST st ON st.contract_id = v.contract_id)",
        _positions("POS", "E0"),
        "E AS (SELECT e.*, CAST(p.slot AS BIGINT) AS slot, CAST(p.off AS INTEGER) AS \"offset\", "
        "CAST(p.slot AS VARCHAR) AS slot_text, " + cls.format(a="e") + " FROM E0 e JOIN POS p USING (contract_id, ordinal))",
    ]


def _sn(b: str) -> str:
    return f"(CASE WHEN {b} <= 0 THEN 1 ELSE ({b} + 31) // 32 END)"


#: Sizes of the stand-in's packable types; a multiset of items is a number with 5 bits of count per size.
SIZES = [1, 2, 4, 8, 12, 16, 20]


def _digit(code: str, k: int) -> str:
    return f"(({code} >> {5 * k}) & 31)"


def packer() -> list[str]:
    """Tables that hold for every group: FILL (item multisets that fit one slot) and BINS (least slots).

    BINS covers every multiset of at most 20 items that some group can hold: adding one item to the best
    (slots, bytes in the last slot) of the multiset without it, least first, gives the best one with it.
    """
    counts = ", ".join(f"range(0, {32 // b + 1}) AS r{k}(c{k})" for k, b in enumerate(SIZES))
    total = " + ".join(f"{b} * c{k}" for k, b in enumerate(SIZES))
    code = " + ".join(f"(c{k} << {5 * k})" for k in range(len(SIZES)))
    sizes = ", ".join(f"({k}, {b}, {1 << 5 * k}::BIGINT)" for k, b in enumerate(SIZES))
    return [
        f"SZ(k, b, one) AS (VALUES {sizes})",
        f"FILL AS MATERIALIZED (SELECT {code} AS code, {', '.join(f'c{k}' for k in range(len(SIZES)))} FROM {counts} "
        f"WHERE {total} BETWEEN 1 AND 32 AND {' AND '.join(f'c{k} <= 20' for k in range(len(SIZES)))})",
        "BEST(code, n, v) AS (SELECT 0::BIGINT, 0, 32 UNION ALL SELECT code, n, min(v) FROM ("
        "SELECT x.code + z.one AS code, x.n + 1 AS n, CASE WHEN x.v % 64 + z.b <= 32 THEN x.v + z.b "
        "ELSE (x.v // 64 + 1) * 64 + z.b END AS v FROM BEST x, SZ z WHERE x.n < 20) GROUP BY code, n)",
        "BINS AS MATERIALIZED (SELECT code, v // 64 AS d FROM BEST)",
    ]


def exact(prefix: str, src: str) -> list[str]:
    """Bins of the packable rows of ``src`` (contract_id, ordinal, number_of_bytes, cls) of all groups.

    {prefix}PN: groups of at most 20 items. {prefix}CH takes, slot after slot (at most 20), the fill whose rest still
    packs into one slot less and whose items make the largest bit mask (bit i: i-th item in order). For
    given counts per size that mask has the last items of each size, so the rest is a prefix of each
    size's items and a group's state is its counts. {prefix}FR is first-fit decreasing, item by item, of
    the larger groups. {prefix}IB has the bin of every item of both.
    """
    p = prefix
    ks, far = range(len(SIZES)), 10**12
    fits = " AND ".join(f"f.c{k} <= {_digit('c.rem', k)}" for k in ks)
    mask = " + ".join(f"g.pb{k}[{_digit('c.rem', k)} + 1] - g.pb{k}[{_digit('c.rem', k)} - f.c{k} + 1]" for k in ks)
    prefix_sums = ", ".join(
        f"list_prepend(0::BIGINT, coalesce(list(upto ORDER BY j) FILTER (WHERE k = {k}), [])) AS pb{k}" for k in ks)
    return (packer() if prefix == "X" else []) + [
        f"{p}P AS MATERIALIZED (SELECT contract_id, ordinal, number_of_bytes AS b, "
        f"CAST(row_number() OVER (PARTITION BY contract_id ORDER BY ordinal) - 1 AS INTEGER) AS i, "
        f"count(*) OVER (PARTITION BY contract_id) AS n FROM {src} WHERE cls = 'packable')",
        f"{p}PN AS (SELECT contract_id, count(*) AS n FROM {p}P GROUP BY 1 HAVING count(*) <= 20 AND min(b) > 0)",
        f"{p}PK AS MATERIALIZED (SELECT q.*, z.k, z.one, "
        f"row_number() OVER (PARTITION BY q.contract_id, z.k ORDER BY q.i) AS j, "
        f"CAST(sum(1::BIGINT << q.i) OVER (PARTITION BY q.contract_id, z.k ORDER BY q.i) AS BIGINT) AS upto "
        f"FROM {p}P q JOIN SZ z ON z.b = q.b WHERE q.n <= 20)",
        f"{p}G AS MATERIALIZED (SELECT contract_id, CAST(sum(one) AS BIGINT) AS code, {prefix_sums} FROM {p}PK GROUP BY 1)",
        f"{p}C0 AS (SELECT contract_id, g.code AS rem, -1 AS bin_no, 0::BIGINT AS fill, s.d FROM {p}G g "
        "JOIN BINS s ON s.code = g.code)",
        # the inner limits keep the join order: fills of each state, a lookup in BINS, then the masks
        *[f"{p}C{step} AS MATERIALIZED (SELECT c.contract_id, any_value(c.rem) - arg_max(f.code, {mask}) AS rem, "
          f"any_value(c.bin_no) + 1 AS bin_no, arg_max(f.code, {mask}) AS fill, any_value(c.d) - 1 AS d FROM ("
          f"SELECT x.* FROM (SELECT c.contract_id, c.rem, c.bin_no, c.d, f.code AS fill, c.rem - f.code AS rest "
          f"FROM {p}C{step - 1} c JOIN FILL f ON {fits} WHERE c.rem > 0 LIMIT {far}) x "
          f"JOIN BINS s ON s.code = x.rest AND s.d = x.d - 1 LIMIT {far}) c "
          f"JOIN {p}G g ON g.contract_id = c.contract_id JOIN FILL f ON f.code = c.fill GROUP BY c.contract_id)"
          for step in range(1, 21)],
        f"{p}CH AS (" + " UNION ALL ".join(f"SELECT * FROM {p}C{step}" for step in range(1, 21)) + ")",
        f"{p}FO AS (SELECT contract_id, ordinal, b, CAST(row_number() OVER (PARTITION BY contract_id "
        f"ORDER BY b DESC, ordinal) AS INTEGER) AS r FROM {p}P WHERE n > 20)",
        f"{p}FR(contract_id, r, ordinal, bin, bins) AS ("
        f"SELECT contract_id, r, ordinal, 0, [b] FROM {p}FO WHERE r = 1 UNION ALL "
        "SELECT o.contract_id, o.r, o.ordinal, "
        "coalesce(list_position(list_transform(x.bins, lambda v: v + o.b <= 32), true) - 1, len(x.bins)), "
        "CASE WHEN list_position(list_transform(x.bins, lambda v: v + o.b <= 32), true) IS NULL "
        "THEN list_append(x.bins, o.b) ELSE list_transform(x.bins, lambda v, k: CASE WHEN k = "
        "list_position(list_transform(x.bins, lambda v2: v2 + o.b <= 32), true) THEN v + o.b ELSE v END) END "
        f"FROM {p}FR x JOIN {p}FO o ON o.contract_id = x.contract_id AND o.r = x.r + 1)",
        f"{p}XB AS (SELECT q.contract_id, q.ordinal, c.bin_no FROM {p}CH c JOIN {p}PK q ON q.contract_id = c.contract_id "
        "AND q.j > ((c.rem >> (5 * q.k)) & 31) AND q.j <= ((c.rem >> (5 * q.k)) & 31) + ((c.fill >> (5 * q.k)) & 31))",
        f"{p}IB AS MATERIALIZED (SELECT contract_id, ordinal, bin_no FROM {p}XB UNION ALL "
        f"SELECT contract_id, ordinal, bin FROM {p}FR)",
    ]


def _with(ctes: list[str], body: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n" + body


BOTH = ("order", "part")


def _recommended(ctes: list[str]) -> list[str]:
    """Recommended slots and order of all contracts."""
    return ctes + exact("X", "E") + [
        "BF AS (SELECT contract_id, bin_no, min(ordinal) AS first_ord, count(*) AS nb FROM XIB GROUP BY 1, 2)",
        "NC AS (SELECT contract_id, count(*) FILTER (WHERE cls = 'full') AS nf FROM E GROUP BY 1)",
        "NB AS (SELECT contract_id, count(*) AS nbins FROM BF GROUP BY 1)",
        "RI AS ("
        "SELECT e.contract_id, e.ordinal, e.label, e.number_of_bytes, e.cls, "
        "CAST(CASE WHEN e.cls = 'full' THEN row_number() OVER (PARTITION BY e.contract_id, e.cls ORDER BY e.ordinal) - 1 "
        "WHEN e.cls = 'dynamic' THEN row_number() OVER (PARTITION BY e.contract_id, e.cls ORDER BY e.ordinal) - 1 "
        "+ nc.nf + coalesce(nb.nbins, 0) ELSE nc.nf + bfr.rk END AS BIGINT) AS slot_index "
        "FROM E e JOIN NC nc USING (contract_id) LEFT JOIN NB nb USING (contract_id) "
        "LEFT JOIN XIB ib ON ib.contract_id = e.contract_id AND ib.ordinal = e.ordinal "
        "LEFT JOIN (SELECT contract_id, bin_no, row_number() OVER (PARTITION BY contract_id ORDER BY first_ord) - 1 AS rk "
        "FROM BF) bfr ON bfr.contract_id = ib.contract_id AND bfr.bin_no = ib.bin_no)",
        "RS AS (SELECT contract_id, slot_index, any_value(cls) AS cls, CAST(sum(number_of_bytes) AS BIGINT) AS s, "
        "CAST(count(*) AS BIGINT) AS n_vars, string_agg(label, ',' ORDER BY ordinal) AS labels FROM RI GROUP BY 1, 2)",
        "RO AS (SELECT r.*, CAST(row_number() OVER (PARTITION BY contract_id ORDER BY slot_index, ordinal) - 1 AS BIGINT) "
        "AS position FROM RI r)",
        f"NF(contract_id, position, s, u, w) AS (SELECT contract_id, position, {_ns('0', '0', 'number_of_bytes')}, "
        f"{_nu('0', 'number_of_bytes')}, {_nw('0', '0', 'number_of_bytes')} FROM RO WHERE position = 0 UNION ALL "
        f"SELECT o.contract_id, o.position, {_ns('n.s', 'n.u', 'o.number_of_bytes')}, {_nu('n.u', 'o.number_of_bytes')}, "
        f"{_nw('n.w', 'n.u', 'o.number_of_bytes')} FROM NF n JOIN RO o ON o.contract_id = n.contract_id "
        f"AND o.position = n.position + 1)",
        "EST0 AS (SELECT n.contract_id, CAST(n.s + CASE WHEN n.u > 0 THEN 1 ELSE 0 END AS BIGINT) AS recommended_slots, "
        "CAST(n.w + CASE WHEN n.u > 0 THEN 32 - n.u ELSE 0 END AS BIGINT) AS recommended_wasted FROM NF n "
        "JOIN (SELECT contract_id, max(position) AS mp FROM RO GROUP BY 1) m "
        "ON m.contract_id = n.contract_id AND m.mp = n.position)",
        "EST AS (SELECT c.contract_id, coalesce(e.recommended_slots, 0) AS recommended_slots, "
        "coalesce(e.recommended_wasted, 0) AS recommended_wasted FROM C c LEFT JOIN EST0 e USING (contract_id))",
    ]


def _structs(ctes: list[str], alone: bool = False) -> list[str]:
    return ctes + (packer() if alone else []) + exact("M", "FL") + [
        "SC AS (SELECT contract_id, type_id, count(*) AS n_fields, "
        "sum(CASE WHEN cls = 'full' THEN (number_of_bytes + 31) // 32 ELSE 0 END) AS full_slots, "
        "count(*) FILTER (WHERE cls = 'dynamic') AS n_dyn, count(*) FILTER (WHERE cls = 'packable') AS n_pack "
        "FROM FL GROUP BY 1, 2)",
        "SB AS (SELECT contract_id, count(DISTINCT bin_no) AS nbins FROM MIB GROUP BY 1)",
        "INST AS (SELECT contract_id, type_id, count(*) AS inst FROM E GROUP BY 1, 2)",
        "SO AS (SELECT st.contract_id, st.type_id, CAST(sc.n_fields AS BIGINT) AS n_fields, "
        "CAST((st.number_of_bytes + 31) // 32 AS BIGINT) AS current_slots, "
        "CAST(sc.full_slots + coalesce(sb.nbins, 0) + sc.n_dyn AS BIGINT) AS optimal_slots, "
        "CAST(coalesce(i.inst, 0) AS BIGINT) AS direct_instances, sc.n_pack "
        "FROM ST st JOIN SC sc USING (contract_id, type_id) LEFT JOIN SB sb USING (contract_id) "
        "LEFT JOIN INST i USING (contract_id, type_id))",
        "SOPT AS (SELECT *, current_slots - optimal_slots AS saved_per_instance, "
        "CAST((current_slots - optimal_slots) * greatest(direct_instances, 0) AS BIGINT) AS total_saved_slots, "
        "(current_slots - optimal_slots) > 0 AS improved, "
        "CASE WHEN n_pack > 20 THEN 'First-Fit Decreasing (heuristic, fallback for n > 20)' "
        "ELSE 'DP-bitmask (exact optimum)' END AS struct_strategy FROM SO)",
    ]


def _report(corpora=BOTH) -> list[str]:
    ctes = _structs(_recommended(base(corpora)))
    return ctes + [
        "CS AS (SELECT contract_id, max(slot + " + _sn("number_of_bytes") + ") AS cs FROM E GROUP BY 1)",
        "CWS AS (SELECT contract_id, slot, sum(number_of_bytes) AS used FROM E GROUP BY 1, 2)",
        "CW AS (SELECT contract_id, sum(" + _sn("used") + " * 32 - used) AS cw FROM CWS GROUP BY 1)",
        "ISS AS (" + _issues_sql() + ")",
        "NI AS (SELECT contract_id, count(*) AS n FROM ISS GROUP BY 1)",
        "STAT AS (SELECT contract_id, count(*) AS n_vars, count(*) FILTER (WHERE cls = 'packable') AS n_packable "
        "FROM E GROUP BY 1)",
        "SSUM AS (SELECT contract_id, count(*) AS structs_total, count(*) FILTER (WHERE improved) AS structs_improved, "
        "coalesce(sum(total_saved_slots) FILTER (WHERE improved), 0) AS struct_saved_slots FROM SOPT GROUP BY 1)",
        "REP AS (SELECT c.contract_id, c.file, c.contract_name, c.contract_ord, 'OK' AS status, "
        "CAST(coalesce(st.n_vars, 0) AS BIGINT) AS n_vars, CAST(coalesce(cs.cs, 0) AS BIGINT) AS current_slots, "
        "CAST(es.recommended_slots AS BIGINT) AS recommended_slots, CAST(coalesce(cw.cw, 0) AS BIGINT) AS current_wasted, "
        "CAST(es.recommended_wasted AS BIGINT) AS recommended_wasted, "
        "CASE WHEN coalesce(st.n_packable, 0) > 20 THEN 'First-Fit Decreasing (heuristic, fallback for n > 20)' "
        "ELSE 'DP-bitmask (exact optimum)' END AS strategy, CAST(coalesce(ni.n, 0) AS BIGINT) AS n_issues, "
        "CAST(coalesce(ss.structs_total, 0) AS BIGINT) AS structs_total, "
        "CAST(coalesce(ss.structs_improved, 0) AS BIGINT) AS structs_improved, "
        "CAST(coalesce(ss.struct_saved_slots, 0) AS BIGINT) AS struct_saved_slots "
        "FROM C c LEFT JOIN STAT st USING (contract_id) LEFT JOIN CS cs USING (contract_id) "
        "LEFT JOIN CW cw USING (contract_id) JOIN EST es USING (contract_id) LEFT JOIN NI ni USING (contract_id) "
        "LEFT JOIN SSUM ss USING (contract_id))",
        "BR AS (SELECT file, contract_name AS contract, status, '' AS error, current_slots, recommended_slots, "
        "current_slots - recommended_slots AS saved_slots, current_wasted, recommended_wasted, "
        "current_wasted - recommended_wasted AS saved_wasted, strategy, 0::BIGINT AS imports_removed, "
        "0::BIGINT AS functions_removed, 0::BIGINT AS modifiers_removed, 0::BIGINT AS types_replaced, "
        "structs_total, structs_improved, struct_saved_slots, contract_ord FROM REP)",
    ]


def _issues_sql() -> str:
    return (
        "SELECT contract_id, 'PARTIAL_SLOT_WASTE' AS code, CASE WHEN used <= 16 THEN 'MEDIUM' ELSE 'LOW' END AS severity, "
        "variable, 'Slot ' || slot_text || ' uses only ' || CAST(used AS VARCHAR) || ' of 32 bytes.' AS message, "
        "'Check whether the small variables can be packed more efficiently.' AS recommendation "
        "FROM (SELECT contract_id, slot_text, CAST(sum(number_of_bytes) AS BIGINT) AS used, "
        "string_agg(label, ', ' ORDER BY label) AS variable FROM E GROUP BY 1, 2) WHERE used < 32 "
        "UNION ALL SELECT contract_id, 'SUBOPTIMAL_ORDER', 'MEDIUM', label, "
        "'The large type ''' || label || ''' separates two small variables that could be grouped more efficiently.', "
        "'Consider reordering variables ' || pl || ', ' || nl || ' before ' || label || '.' "
        "FROM (" + _order_window() + ") WHERE number_of_bytes >= 32 AND pp AND np"
    )


def _order_window() -> str:
    pk = "(lower(encoding) = 'inplace' AND number_of_bytes > 0 AND number_of_bytes < 32)"
    w = "OVER (PARTITION BY contract_id ORDER BY slot, \"offset\", ordinal)"
    return (f"SELECT contract_id, ordinal, label, number_of_bytes, lag({pk}) {w} AS pp, lead({pk}) {w} AS np, "
            f"lag(label) {w} AS pl, lead(label) {w} AS nl FROM E")


def oracle_sql() -> dict[str, str]:
    b2 = base(BOTH)
    q: dict[str, str] = {}
    q["declared_layout"] = _with(
        base(BOTH),
        "SELECT contract_id, ordinal, CAST(slot AS BIGINT) AS slot, CAST(off AS INTEGER) AS \"offset\" FROM POS")
    q["current_slots"] = _with(b2, "SELECT c.contract_id, CAST(coalesce(m.cs, 0) AS BIGINT) AS current_slots FROM C c "
                               "LEFT JOIN (SELECT contract_id, max(slot + " + _sn("number_of_bytes") + ") AS cs "
                               "FROM E GROUP BY 1) m USING (contract_id)")
    q["current_waste"] = _with(b2, "SELECT c.contract_id, CAST(coalesce(m.w, 0) AS BIGINT) AS current_wasted FROM C c "
                               "LEFT JOIN (SELECT contract_id, sum(" + _sn("used") + " * 32 - used) AS w FROM "
                               "(SELECT contract_id, slot, sum(number_of_bytes) AS used FROM E GROUP BY 1, 2) "
                               "GROUP BY 1) m USING (contract_id)")
    q["slot_view"] = _with(b2, "SELECT contract_id, slot, CAST(used AS BIGINT) AS used, CAST(" + _sn("used") +
                           " AS BIGINT) AS slots_spanned, CAST(" + _sn("used") + " * 32 - used AS BIGINT) AS wasted, "
                           "n_vars, labels FROM (SELECT contract_id, slot, sum(number_of_bytes) AS used, "
                           "CAST(count(*) AS BIGINT) AS n_vars, string_agg(label, ',' ORDER BY \"offset\", ordinal) AS labels "
                           "FROM E GROUP BY 1, 2)")
    q["partial_slot_waste"] = _with(
        b2, "SELECT contract_id, 'PARTIAL_SLOT_WASTE' AS code, CASE WHEN used <= 16 THEN 'MEDIUM' ELSE 'LOW' END AS severity, "
            "variable, 'Slot ' || slot_text || ' uses only ' || CAST(used AS VARCHAR) || ' of 32 bytes.' AS message, "
            "'Check whether the small variables can be packed more efficiently.' AS recommendation, slot_text, used "
            "FROM (SELECT contract_id, slot_text, CAST(sum(number_of_bytes) AS BIGINT) AS used, "
            "string_agg(label, ', ' ORDER BY label) AS variable FROM E GROUP BY 1, 2) WHERE used < 32")
    q["suboptimal_order"] = _with(
        b2, "SELECT contract_id, 'SUBOPTIMAL_ORDER' AS code, 'MEDIUM' AS severity, label AS variable, "
            "'The large type ''' || label || ''' separates two small variables that could be grouped more efficiently.' AS message, "
            "'Consider reordering variables ' || pl || ', ' || nl || ' before ' || label || '.' AS recommendation, ordinal "
            "FROM (" + _order_window() + ") WHERE number_of_bytes >= 32 AND pp AND np")
    q["issues"] = _with(b2, _issues_sql())
    q["strategy"] = _with(
        b2, "SELECT c.contract_id, CAST(coalesce(s.n_vars, 0) AS BIGINT) AS n_vars, CAST(coalesce(s.np, 0) AS BIGINT) AS n_packable, "
            "CAST(coalesce(s.nf, 0) AS BIGINT) AS n_full, CAST(coalesce(s.nd, 0) AS BIGINT) AS n_dynamic, "
            "CASE WHEN coalesce(s.np, 0) > 20 THEN 'First-Fit Decreasing (heuristic, fallback for n > 20)' "
            "ELSE 'DP-bitmask (exact optimum)' END AS strategy FROM C c LEFT JOIN (SELECT contract_id, count(*) AS n_vars, "
            "count(*) FILTER (WHERE cls = 'packable') AS np, count(*) FILTER (WHERE cls = 'full') AS nf, "
            "count(*) FILTER (WHERE cls = 'dynamic') AS nd FROM E GROUP BY 1) s USING (contract_id)")
    bo = b2 + exact("X", "E")
    q["pack_exact_count"] = _with(bo, (
        "SELECT n.contract_id, CAST(n.n AS BIGINT) AS n_items, CAST(s.d AS BIGINT) AS bins "
        "FROM XPN n JOIN XG g USING (contract_id) JOIN BINS s ON s.code = g.code"))
    q["pack_exact_bins"] = _with(bo,
                                 "SELECT contract_id, ordinal, CAST(min(ordinal) OVER (PARTITION BY contract_id, bin_no) "
                                 "AS INTEGER) AS group_first FROM XXB")
    q["pack_ffd"] = _with(bo, "SELECT contract_id, ordinal, CAST(bin AS BIGINT) AS bin FROM XFR")
    q.update(_wide())
    rec = _recommended(b2)
    q["recommended_slots"] = _with(
        rec, "SELECT contract_id, slot_index, CASE WHEN cls = 'full' THEN 'full' WHEN cls = 'dynamic' THEN 'dynamic' "
             "WHEN s = 32 THEN 'group_full' ELSE 'group_partial' END AS note_code, "
             "CAST(CASE WHEN cls = 'packable' THEN s ELSE 32 END AS BIGINT) AS used, "
             "CAST(CASE WHEN cls = 'packable' THEN 32 - s ELSE 0 END AS BIGINT) AS wasted, "
             "CAST(CASE WHEN cls = 'full' THEN (s + 31) // 32 ELSE 1 END AS BIGINT) AS slots_spanned, n_vars, labels FROM RS")
    q["recommended_order"] = _with(
        rec, "SELECT r.contract_id, r.position, r.slot_index, r.ordinal, r.label, r.number_of_bytes, "
             "CASE WHEN r.cls = 'full' THEN 'full' WHEN r.cls = 'dynamic' THEN 'dynamic' WHEN s.s = 32 THEN 'group_full' "
             "ELSE 'group_partial' END AS note_code FROM RO r JOIN RS s USING (contract_id, slot_index)")
    q["next_fit_estimate"] = _with(rec, "SELECT contract_id, recommended_slots, recommended_wasted FROM EST")
    q["struct_optimization"] = _with(
        _structs(base(BOTH), True),
        "SELECT contract_id, type_id, n_fields, current_slots, optimal_slots, direct_instances, "
        "CAST(saved_per_instance AS BIGINT) AS saved_per_instance, total_saved_slots, improved, struct_strategy FROM SOPT")
    rep = _report()
    q["contract_report"] = _with(rep, "SELECT contract_id, file, contract_name, status, n_vars, current_slots, "
                                      "recommended_slots, current_wasted, recommended_wasted, strategy, n_issues, "
                                      "structs_total, structs_improved, struct_saved_slots FROM REP")
    prof_ctes = _sources_sql()[len(base(BOTH)):] + ["PROF AS (" + _profile_sql() + ")"]
    q["bulk_rows"] = _with(rep + prof_ctes, (
        "SELECT b.* EXCLUDE (contract_ord, imports_removed, functions_removed, types_replaced), "
        "coalesce(p.imports_removed, 0) AS imports_removed, coalesce(p.functions_removed, 0) AS functions_removed, "
        "coalesce(p.types_replaced, 0) AS types_replaced "
        "FROM BR b LEFT JOIN PROF p USING (file)"))
    summary = (
        "SELECT CAST(count(DISTINCT file) AS BIGINT) AS files, CAST(count(*) FILTER (WHERE status = 'ERROR') AS BIGINT) AS file_errors, "
        "CAST(count(*) FILTER (WHERE status = 'OK') AS BIGINT) AS contracts_ok, "
        "CAST(count(*) FILTER (WHERE status = 'ERROR') AS BIGINT) AS contracts_error, "
        "CAST(count(*) FILTER (WHERE status = 'EMPTY') AS BIGINT) AS contracts_empty, "
        "CAST(count(*) FILTER (WHERE status = 'OK' AND starts_with(strategy, 'DP')) AS BIGINT) AS strategy_exact, "
        "CAST(count(*) FILTER (WHERE status = 'OK' AND starts_with(strategy, 'First')) AS BIGINT) AS strategy_ffd, "
        "CAST(coalesce(sum(saved_slots) FILTER (WHERE status = 'OK'), 0) AS BIGINT) AS saved_slots, "
        "CAST(coalesce(sum(saved_wasted) FILTER (WHERE status = 'OK'), 0) AS BIGINT) AS saved_bytes, "
        "CAST(coalesce(sum(structs_total) FILTER (WHERE status = 'OK'), 0) AS BIGINT) AS structs_total, "
        "CAST(coalesce(sum(structs_improved) FILTER (WHERE status = 'OK'), 0) AS BIGINT) AS structs_improved, "
        "CAST(coalesce(sum(struct_saved_slots) FILTER (WHERE status = 'OK'), 0) AS BIGINT) AS struct_saved_slots, "
        "CAST(count(*) FILTER (WHERE status = 'OK' AND (saved_slots > 0 OR struct_saved_slots > 0)) AS BIGINT) AS winners "
        )
    q["bulk_summary"] = _with(rep, summary + "FROM BR")
    kind = ("CASE WHEN starts_with(replace(file, '\\', '/'), 'real/') THEN 'real' "
            "WHEN starts_with(replace(file, '\\', '/'), 'synthetic/') THEN 'synthetic' ELSE 'other' END")
    q["dataset_report"] = _with(rep, (
        "SELECT *, CAST(CASE WHEN contracts_ok = 0 THEN 0.0 ELSE round(CAST(winners AS DOUBLE) * 1000.0 / contracts_ok) / 10.0 END AS DOUBLE) AS winners_pct, "
        "CAST(total_saved_slots * 20000 AS BIGINT) AS gas_saved FROM ("
        "SELECT CAST(count(*) AS BIGINT) AS contracts_total, CAST(count(*) FILTER (WHERE ok) AS BIGINT) AS contracts_ok, "
        "CAST(count(*) FILTER (WHERE status = 'ERROR') AS BIGINT) AS contracts_error, "
        "CAST(count(*) FILTER (WHERE ok AND kind = 'real') AS BIGINT) AS real_count, "
        "CAST(count(*) FILTER (WHERE ok AND kind = 'synthetic') AS BIGINT) AS synthetic_count, "
        "CAST(coalesce(sum(tot) FILTER (WHERE ok), 0) AS BIGINT) AS total_saved_slots, "
        "CAST(coalesce(sum(saved_wasted) FILTER (WHERE ok), 0) AS BIGINT) AS total_saved_bytes, "
        "CAST(coalesce(sum(tot) FILTER (WHERE ok AND kind = 'real'), 0) AS BIGINT) AS real_saved_slots, "
        "CAST(coalesce(sum(tot) FILTER (WHERE ok AND kind = 'synthetic'), 0) AS BIGINT) AS synthetic_saved_slots, "
        "CAST(count(*) FILTER (WHERE ok AND NOT coalesce(starts_with(strategy, 'First'), false)) AS BIGINT) AS strategy_exact, "
        "CAST(count(*) FILTER (WHERE ok AND coalesce(starts_with(strategy, 'First'), false)) AS BIGINT) AS strategy_ffd, "
        "CAST(coalesce(sum(structs_improved) FILTER (WHERE ok), 0) AS BIGINT) AS structs_improved, "
        "CAST(coalesce(sum(struct_saved_slots) FILTER (WHERE ok), 0) AS BIGINT) AS struct_saved_slots, "
        "CAST(count(*) FILTER (WHERE ok AND tot > 0) AS BIGINT) AS winners "
        f"FROM (SELECT *, status = 'OK' AS ok, saved_slots + struct_saved_slots AS tot, {kind} AS kind FROM BR))"))
    q["top_contracts"] = _with(rep, (
        "SELECT file, contract, CASE WHEN starts_with(strategy, 'First') THEN 'FFD' ELSE 'DP-bitmask' END AS strategy, "
        f"{kind} AS kind, saved_slots, saved_wasted AS saved_bytes, struct_saved_slots, "
        "CAST(saved_slots + struct_saved_slots AS BIGINT) AS total_saved FROM BR "
        "WHERE status = 'OK' AND saved_slots + struct_saved_slots > 0 "
        "ORDER BY total_saved DESC, saved_wasted DESC, file, contract_ord LIMIT 30"))
    q["top_contracts_cli"] = _with(rep, (
        "SELECT file, contract, total_saved, saved_slots, saved_wasted, struct_saved_slots, "
        "CASE WHEN starts_with(strategy, 'First') THEN '[FFD]' ELSE '[DP] ' END AS strategy_tag, "
        "CASE WHEN struct_saved_slots > 0 AND saved_slots > 0 THEN '-' || total_saved || ' slots (' || saved_slots || "
        "' state + ' || struct_saved_slots || ' struct)' WHEN struct_saved_slots > 0 THEN '-' || struct_saved_slots || "
        "' slots (internal struct)' ELSE '-' || saved_slots || ' slots, -' || saved_wasted || ' bytes' END AS detail "
        "FROM (SELECT *, CAST(saved_slots + struct_saved_slots AS BIGINT) AS total_saved FROM BR) "
        "WHERE status = 'OK' AND (saved_slots > 0 OR struct_saved_slots > 0) "
        "ORDER BY total_saved DESC, saved_wasted DESC, file, contract_ord LIMIT 10"))
    q["leaderboard"] = _with(rep, (
        "SELECT * FROM (SELECT file, contract, CASE WHEN starts_with(strategy, 'First') THEN 'FFD' ELSE 'DP-bitmask' END "
        f"AS strategy, {kind} AS kind, saved_slots, saved_wasted AS saved_bytes, struct_saved_slots, "
        "CAST(saved_slots + struct_saved_slots AS BIGINT) AS total_saved FROM BR "
        "WHERE status = 'OK' AND saved_slots + struct_saved_slots > 0 "
        "ORDER BY total_saved DESC, saved_wasted DESC, file, contract_ord LIMIT 30) WHERE kind = 'synthetic' "
        "ORDER BY saved_slots DESC, total_saved DESC, saved_bytes DESC, file, contract LIMIT 15 OFFSET 0"))
    q["merged_dataset_report"] = q["dataset_report"]
    part = ", ".join(f"CAST(coalesce(sum({c}), 0) AS BIGINT) AS {c}" for c in (
        "saved_slots", "saved_wasted", "structs_total", "structs_improved", "struct_saved_slots"))
    split = ", ".join(f"CASE WHEN grouping({c}) = 1 THEN 'all' ELSE {c} END AS {c}" for c in ("kind", "tag", "status"))
    q["savings_cube"] = _with(rep, (
        f"SELECT {split}, CAST(count(*) AS BIGINT) AS rows, {part}, "
        "CAST(count(*) FILTER (WHERE saved_slots > 0 OR struct_saved_slots > 0) AS BIGINT) AS winners, "
        "CAST(count(*) FILTER (WHERE saved_slots + struct_saved_slots > 0) AS BIGINT) AS winners_total "
        f"FROM (SELECT *, {kind} AS kind, CASE WHEN starts_with(strategy, 'DP') THEN 'exact' WHEN starts_with(strategy, 'First') "
        "THEN 'ffd' ELSE '' END AS tag FROM BR) GROUP BY GROUPING SETS ((kind), (tag), (status), (kind, status), ())"))
    q["savings_preview"] = _with(rep, (
        "SELECT s.file, CAST(s.st + coalesce(t.sv, 0) AS BIGINT) AS slots_saved, "
        "CAST((s.st + coalesce(t.sv, 0)) * 20000 AS BIGINT) AS gas_saved, (s.st + coalesce(t.sv, 0)) <= 0 AS already_optimal "
        "FROM (SELECT file, sum(current_slots - recommended_slots) AS st FROM REP WHERE status = 'OK' GROUP BY 1) s "
        "LEFT JOIN (SELECT r.file, sum(o.total_saved_slots) AS sv FROM SOPT o JOIN REP r USING (contract_id) "
        "WHERE o.saved_per_instance > 0 AND r.status = 'OK' GROUP BY 1) t USING (file)"))
    ing = base(BOTH) + ["IDS AS (SELECT contract_id, 'layouts/' || contract_id || '.json:' || file || ':' "
                                      "|| contract_name AS doc_id FROM C)"]
    q["layout_ingest"] = _with(ing, "SELECT i.doc_id AS contract_id, e.ordinal, e.label, e.\"offset\", e.slot_text, e.slot, "
                                    "e.type_id, e.number_of_bytes, e.type_label, e.encoding FROM E e JOIN IDS i USING (contract_id)")
    q["layout_structs"] = _with(ing, "SELECT i.doc_id AS contract_id, f.type_id, st.number_of_bytes AS struct_bytes, f.ordinal, "
                                     "f.label, f.member_type_id, f.type_label, f.number_of_bytes, f.encoding, f.slot, "
                                     "f.\"offset\" FROM FL f JOIN ST st USING (contract_id, type_id) JOIN IDS i USING (contract_id)")
    q["bulk_csv_report"] = q["dataset_report"]
    q["first_contracts"] = _with([_contracts(BOTH)], (
        "SELECT file, arg_min(contract_name, contract_ord) AS contract_name, "
        "arg_min(contract_id, contract_ord) AS contract_id FROM C GROUP BY file"))
    docs = [
        "DOC AS (SELECT c.contract_id, 'layouts/' || c.contract_id || '.json' AS file, c.contract_name, "
        "CAST(substr(c.contract_id, 2) AS BIGINT) % 40 AS m, EXISTS (SELECT 1 FROM V WHERE V.contract_id = c.contract_id) AS filled "
        "FROM C c)",
        "BAD AS (SELECT contract_id, file, CASE m WHEN 7 THEN 'Stand-in message for ' || contract_name || chr(10) || 'second line' "
        "WHEN 8 THEN 'Unreadable compiler output (corrupt JSON).' WHEN 9 THEN 'No contracts returned by the compiler.' "
        "WHEN 10 THEN 'No storageLayout in the compiler output.' END AS error, m = 12 AND filled AS huge FROM DOC)"]
    q["file_status"] = _with([_vars(BOTH), _contracts(BOTH), *docs], (
        "SELECT file, CASE WHEN error IS NULL THEN 'OK' ELSE 'ERROR' END AS status, coalesce(error, '') AS error FROM BAD"))
    zeros = ", ".join(f"0::BIGINT AS {c}" for c in (
        "current_slots", "recommended_slots", "saved_slots", "current_wasted", "recommended_wasted", "saved_wasted"))
    counters = ", ".join(f"0::BIGINT AS {c}" for c in (
        "imports_removed", "functions_removed", "modifiers_removed", "types_replaced"))
    doc_rows = [*rep, *docs, "DBR AS (SELECT d.file, r.contract_name AS contract, 'OK' AS status, '' AS error, r.current_slots, "
                "r.recommended_slots, r.current_slots - r.recommended_slots AS saved_slots, r.current_wasted, "
                "r.recommended_wasted, r.current_wasted - r.recommended_wasted AS saved_wasted, r.strategy, " + counters +
                ", r.structs_total, r.structs_improved, r.struct_saved_slots FROM REP r JOIN DOC d USING (contract_id) "
                "JOIN BAD b USING (contract_id) WHERE b.error IS NULL AND NOT b.huge UNION ALL SELECT file, '', 'ERROR', "
                "split_part(coalesce(error, 'SLOT_OUT_OF_RANGE: slot 99999999999999999999 does not fit a 64-bit integer'), "
                "chr(10), 1), " + zeros + ", '', " + counters + ", 0, 0, 0 FROM BAD WHERE error IS NOT NULL OR huge)"]
    q["document_bulk_rows"] = _with(doc_rows, "SELECT * FROM DBR")
    q["document_bulk_summary"] = _with(doc_rows, summary + "FROM DBR")
    q["csv_top_contracts"] = q["top_contracts"].replace("file, contract_ord LIMIT", "file, contract LIMIT")
    q["report_documents"] = _with(rep, (
        "SELECT r.contract_id, r.slot_index, CASE WHEN r.cls = 'full' THEN 'Occupies its own slot (>= 32 bytes)' "
        "WHEN r.cls = 'dynamic' THEN 'Dynamic type (' || e.encoding || ') - own slot handle' "
        "WHEN s.s = 32 THEN 'Slot completely filled by grouping (' || t.tag || ')' "
        "ELSE t.tag || ' grouping (' || s.s || '/32 bytes used)' END AS note, "
        "CAST(row_number() OVER (PARTITION BY r.contract_id, r.slot_index ORDER BY r.ordinal) - 1 AS INTEGER) AS place, "
        "r.label, e.type_label, r.number_of_bytes FROM RI r JOIN RS s USING (contract_id, slot_index) "
        "JOIN E e ON e.contract_id = r.contract_id AND e.ordinal = r.ordinal JOIN (SELECT contract_id, "
        "CASE WHEN starts_with(strategy, 'First') THEN 'FFD' ELSE 'DP-bitmask' END AS tag FROM REP) t "
        "ON t.contract_id = r.contract_id"))
    q["report_issues"] = q["issues"]
    order = (
        "SELECT f.contract_id, f.type_id, CAST(row_number() OVER (PARTITION BY f.contract_id, f.type_id ORDER BY "
        "CASE f.cls WHEN 'full' THEN 0 WHEN 'packable' THEN 1 ELSE 2 END, coalesce(b.first_ord, f.ordinal), f.ordinal) - 1 "
        "AS BIGINT) AS position, f.ordinal, f.label FROM FL f LEFT JOIN (SELECT contract_id, ordinal, "
        "min(ordinal) OVER (PARTITION BY contract_id, bin_no) AS first_ord FROM MIB) b "
        "ON b.contract_id = f.contract_id AND b.ordinal = f.ordinal")
    q["struct_field_order"] = _with(_structs(base(BOTH), True), order)
    q["report_structs"] = _with(_structs(base(BOTH), True), (
        "SELECT s.contract_id, s.type_id, s.current_slots, s.optimal_slots, s.direct_instances, s.total_saved_slots, "
        "s.struct_strategy, o.field_order FROM SOPT s LEFT JOIN (SELECT contract_id, type_id, "
        f"string_agg(label, ',' ORDER BY position) AS field_order FROM ({order}) GROUP BY 1, 2) o USING (contract_id, type_id)"))
    src = _sources_sql()
    q["source_profile"] = _with(src, _profile_sql())
    q["external_types"] = _with(src, _ext_sql())
    q["local_declarations"] = _with(src, (
        "SELECT file, unnest(['IHook', 'Mode', 'Idle', 'Busy', 'Pair']) AS name FROM SRC UNION ALL "
        "SELECT c.file, c.contract_name FROM C c JOIN DL d USING (contract_id)"))
    q["inheritance_edges"] = _with(src, (
        "SELECT c.file, c.contract_name AS child, p.parent, p.position FROM C c JOIN DL d USING (contract_id) JOIN "
        "(VALUES ('Base', 0, 1), ('Ownable', 1, 4), ('Named', 2, 4)) p(parent, position, least) ON d.n >= p.least"))
    q["normalized_source"] = _with(src, (
        "SELECT file, regexp_replace(regexp_replace(replace(replace(replace(text, 'pragma solidity 0.8.19;', "
        "'pragma solidity ^0.8.19;'), '@inheritdoc Base', ''), '    using SafeMath for uint256;', "
        "'// removed: using SafeMath for uint256;'), '(?m)^(import .*;)$', '// removed: \\1', 'g'), "
        "'(contract \\w+) is (Base[^{]*) [{]', '\\1 /* removed: is \\2 */ {', 'g') || chr(10) AS normalized FROM SRC"))
    q["verified_source"] = _with(src + [
        "LAST AS (SELECT file, arg_max(contract_name, contract_ord) AS last_name FROM C GROUP BY 1)"], (
        "SELECT '0x' || sha1(file) AS address, name AS contract_name, NOT starts_with(file, 'pending/') AS multi_file, "
        "CASE WHEN starts_with(file, 'pending/') THEN text "
        "WHEN trim(name) <> '' AND (contains(text, 'contract ' || name) OR contains('contract Base {}', 'contract ' || name)) "
        "THEN CASE WHEN contains(text, 'contract ' || name) THEN text ELSE 'contract Base {}' END "
        "ELSE 'contract Base {}' || chr(10) || text || chr(10) END AS solidity, "
        "'0x' || sha1(file) AS link_address, '0x' || sha1(file) AS path_address "
        "FROM (SELECT s.file, s.text, CASE WHEN length(s.file) % 3 = 0 THEN 'Vault' ELSE l.last_name END AS name "
        "FROM SRC s JOIN LAST l USING (file))"))
    q["contract_sources"] = _with(src, (
        "SELECT c.contract_id, c.file, CAST(length(s.text) AS BIGINT) AS n_chars, "
        "CAST(len(string_split(s.text, chr(10))) AS BIGINT) AS n_lines FROM C c JOIN SRC s USING (file)"))
    q["examples"] = _with(src, (
        "SELECT 'ex-' || substr(sha1(s.file), 1, 8) AS id, f.title, upper(" + _kind("s.file") + ") AS tag, "
        + _kind("s.file") + " AS kind, 'Contracts of ' || s.file AS description, s.text AS source "
        "FROM SRC s JOIN (SELECT file, arg_min(contract_name, contract_ord) AS title FROM C GROUP BY 1) f USING (file)"))
    for name in ("contract_report", "bulk_summary", "dataset_report", "top_contracts"):
        q[f"{name}_all"] = q[name]
    for name in WHOLE_FILES:
        q[name] = q[name].replace(_BY_THOUSAND, "")
    return q


def _wide() -> dict[str, str]:
    """Packing of order lines with capacities of 5000 and 1000, item by item."""
    room = "list_position(list_transform(x.bins, lambda v: v + o.b <= 5000), true)"
    lines = ("W AS MATERIALIZED (SELECT l_partkey, l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) * {k} AS b, "
             "row_number() OVER (PARTITION BY l_partkey ORDER BY {by}) AS r FROM lineitem)")
    fit = _with([
        lines.format(k=97, by="CAST(l_quantity AS BIGINT) DESC, l_orderkey, l_linenumber"),
        "R(l_partkey, l_orderkey, l_linenumber, b, r, bin, bins) AS ("
        "SELECT l_partkey, l_orderkey, l_linenumber, b, r, 0, [b] FROM W WHERE r = 1 UNION ALL "
        f"SELECT o.l_partkey, o.l_orderkey, o.l_linenumber, o.b, o.r, coalesce({room} - 1, len(x.bins)), "
        f"CASE WHEN {room} IS NULL THEN list_append(x.bins, o.b) ELSE list_transform(x.bins, lambda v, k: "
        "CASE WHEN k = list_position(list_transform(x.bins, lambda v2: v2 + o.b <= 5000), true) THEN v + o.b ELSE v END) END "
        "FROM R x JOIN W o ON o.l_partkey = x.l_partkey AND o.r = x.r + 1)"],
        "SELECT l_partkey, l_orderkey, l_linenumber, b AS volume, CAST(bin AS BIGINT) AS bin FROM R")
    # a state is bins * 4096 + room used in the last bin; the least one of each set of lines, one more line a round
    exact = _with([
        "I AS MATERIALIZED (SELECT l_orderkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS INTEGER) "
        "AS i, CAST((l_partkey * 37 + l_suppkey * 11) % 600 + 100 AS BIGINT) AS b, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem)",
        "D(o, mask, n, v) AS (SELECT DISTINCT l_orderkey, 0::BIGINT, n, 1000::BIGINT FROM I UNION ALL "
        "SELECT o, mask, n, min(v) FROM (SELECT d.o, d.mask | (1::BIGINT << i.i) AS mask, d.n, CASE WHEN d.v % 4096 + i.b <= 1000 "
        "THEN d.v + i.b ELSE (d.v // 4096 + 1) * 4096 + i.b END AS v FROM D d JOIN I i ON i.l_orderkey = d.o "
        "AND ((d.mask >> i.i) & 1) = 0) GROUP BY o, mask, n)"],
        "SELECT o AS l_orderkey, CAST(n AS BIGINT) AS n_items, CAST(v // 4096 AS BIGINT) AS bins FROM D WHERE mask = (1::BIGINT << n) - 1")
    closes = "x.u > 0 AND (o.b >= 5000 OR x.u + o.b > 5000)"
    step = ("CASE WHEN {b} >= 5000 THEN {s} + (({b} + 4999) // 5000) WHEN {u} + {b} = 5000 THEN {s} + 1 ELSE {s} END, "
            "CASE WHEN {b} >= 5000 OR {u} + {b} = 5000 THEN 0 ELSE {u} + {b} END")
    s1, u1 = f"(x.s + CASE WHEN {closes} THEN 1 ELSE 0 END)", f"(CASE WHEN {closes} THEN 0 ELSE x.u END)"
    waste = "CASE WHEN {b} >= 5000 THEN (5000 - {b} % 5000) % 5000 ELSE 0 END"
    placed = [lines.format(k=131, by="l_orderkey, l_linenumber, l_quantity"),
              "N(l_partkey, l_orderkey, l_linenumber, r, slot, off, s, u, w) AS (SELECT l_partkey, l_orderkey, l_linenumber, r, 0::BIGINT, "
              f"0::BIGINT, {step.format(b='b', s='0::BIGINT', u='0::BIGINT')}, {waste.format(b='b')} FROM W WHERE r = 1 UNION ALL "
              f"SELECT o.l_partkey, o.l_orderkey, o.l_linenumber, o.r, {s1}, {u1}, {step.format(b='o.b', s=s1, u=u1)}, "
              f"x.w + CASE WHEN {closes} THEN 5000 - x.u ELSE 0 END + {waste.format(b='o.b')} "
              "FROM N x JOIN W o ON o.l_partkey = x.l_partkey AND o.r = x.r + 1)"]
    return {
        "pack_ffd_wide": fit, "pack_exact_wide": exact,
        "next_fit_wide": _with(placed, "SELECT l_partkey, l_orderkey, l_linenumber, CAST(slot AS BIGINT) AS slot, "
                                       "CAST(off AS BIGINT) AS \"offset\" FROM N"),
        "next_fit_wide_totals": _with(placed, "SELECT l_partkey, CAST(s + CASE WHEN u > 0 THEN 1 ELSE 0 END AS BIGINT) AS slots, "
                                              "CAST(w + CASE WHEN u > 0 THEN 5000 - u ELSE 0 END AS BIGINT) AS wasted "
                                              "FROM N QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY r DESC) = 1"),
    }


def _kind(f: str) -> str:
    return (f"(CASE WHEN starts_with(replace({f}, '\\', '/'), 'real/') THEN 'real' "
            f"WHEN starts_with(replace({f}, '\\', '/'), 'synthetic/') THEN 'synthetic' ELSE 'other' END)")


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _sources_sql() -> list[str]:
    nl = "chr(10)"
    dt = ("CASE WHEN type_id = 't_address' AND ordinal % 2 = 1 THEN 'Token' "
          "WHEN type_id = 't_uint128' AND ordinal % 2 = 1 THEN 'Vault[]' "
          f"WHEN type_id = '{STRUCT_TYPE_ID}' THEN 'Pair' WHEN starts_with(type_id, 't_mapping') AND ordinal % 2 = 1 "
          "THEN 'mapping(address owner => IERC20 token)' ELSE type_label END")
    prelude = " || chr(10) || ".join(_lit(x) for x in FILE_PRELUDE)
    return base(BOTH) + [
        f"DL AS (SELECT contract_id, string_agg('    ' || ({dt}) || ' public ' || label || ';', {nl} ORDER BY ordinal) AS decls, "
        "count(*) AS n, max(CASE WHEN starts_with(type_id, 't_mapping') THEN 1 ELSE 0 END) AS hm FROM E GROUP BY 1)",
        "CT AS (SELECT c.file, c.contract_ord, 'contract ' || c.contract_name || ' is Base' || "
        f"CASE WHEN d.n >= 4 THEN ', Ownable(msg.sender), Named(\"My (x) Token\", key(1, 2))' ELSE '' END || ' {{' || {nl} || "
        f"'    // note: (a) => b {{' || {nl} || "
        f"CASE WHEN d.n % 2 = 1 THEN '    using SafeMath for uint256;' || {nl} ELSE '' END || "
        f"'    enum Mode {{' || {nl} || '        Idle,' || {nl} || '        Busy' || {nl} || '    }}' || {nl} || '    struct Pair {{ uint64 a; bool b; }}' || {nl} || "
        f"d.decls || {nl} || CASE WHEN d.hm = 1 THEN '    /// @inheritdoc Base' || {nl} ELSE '' END || "
        "'    constructor(uint256 a) Base(a)' || CASE WHEN d.n >= 4 THEN ' Ownable(msg.sender)' ELSE '' END || "
        f"' {{}}' || {nl} || '    function touch() external {{' || {nl} || '        if (true) {{ emit Log(\"}}\"); }}' || {nl} || "
        f"'    }}' || {nl} || '}}' AS ctext "
        "FROM C c JOIN DL d USING (contract_id))",
        f"SRC AS (SELECT file, '// SPDX-License-Identifier: MIT' || {nl} || CASE WHEN starts_with(file, 'real/') "
        f"THEN {_lit(FILE_HEADER_FIXED)} ELSE {_lit(FILE_HEADER_CARET)} END || {nl} || {prelude} || {nl} || "
        f"string_agg(ctext, {nl} ORDER BY contract_ord) AS text FROM CT GROUP BY file)",
    ]


def _ext_sql() -> str:
    """External types of each file, by what the stand-in declares."""
    return ("SELECT DISTINCT c.file, CASE WHEN e.type_id = 't_address' THEN 'Token' WHEN e.type_id = 't_uint128' THEN 'Vault' "
            "ELSE 'IERC20' END AS type FROM E e JOIN C c USING (contract_id) WHERE e.ordinal % 2 = 1 AND (e.type_id IN "
            "('t_address', 't_uint128') OR starts_with(e.type_id, 't_mapping'))")


def _profile_sql() -> str:
    """Counters of each file, added up over its contracts (CD: contracts that have variables)."""
    return (
        "SELECT *, imports_removed + inheritance_removed + usings_removed + parent_calls_removed + functions_removed "
        "+ types_replaced > 0 AS modified, "
        "'Isolated analysis: ' || imports_removed || ' imports, ' || inheritance_removed || ' inheritance lists, ' || "
        "usings_removed || ' using directives, ' || parent_calls_removed || ' parent calls, ' || functions_removed || "
        "' function bodies stripped, 0 external modifiers removed from signatures, ' || inheritdoc_removed || "
        "' @inheritdoc tags removed, ' || types_replaced || ' external types replaced with address in state "
        "vars/mapping/array. The layout reflects ONLY the variables declared in this file.' AS warning, "
        "CASE WHEN types_replaced > 0 THEN 'External types replaced with `address`: ' || external_types END AS types_warning "
        "FROM (SELECT x.file, starts_with(x.file, 'real/') AS pragma_relaxed, CAST(sum(x.hm) AS BIGINT) AS inheritdoc_removed, "
        "2::BIGINT AS imports_removed, CAST(sum(x.n % 2) AS BIGINT) AS usings_removed, "
        "CAST(count(*) AS BIGINT) AS inheritance_removed, "
        "CAST(sum(CASE WHEN x.n >= 4 THEN 2 ELSE 1 END) AS BIGINT) AS parent_calls_removed, "
        "CAST(1 + 2 * count(*) AS BIGINT) AS functions_removed, CAST(coalesce(any_value(y.n), 0) AS BIGINT) AS types_replaced, "
        "coalesce(any_value(y.names), '') AS external_types FROM (SELECT c.file, d.n, d.hm FROM C c JOIN DL d USING (contract_id)) x "
        "LEFT JOIN (SELECT file, count(*) AS n, string_agg(type, ', ' ORDER BY type) AS names FROM (" + _ext_sql() + ") GROUP BY 1) y "
        "ON y.file = x.file GROUP BY x.file)"
    )
