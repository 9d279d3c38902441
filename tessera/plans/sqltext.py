"""Common table expressions of the SQL counterparts, for DuckDB."""

SRC = """src AS (SELECT CAST(floor(l_quantity*5) AS INT) r, CAST(floor(l_extendedprice/412) AS INT) g, CAST(floor(l_discount*100+5e-1) AS INT)*25 b,
 CASE l_returnflag WHEN 'R' THEN 64 WHEN 'A' THEN 128 ELSE 255 END a FROM lineitem)"""
TGT = """tgt AS (SELECT event_id px_id, CAST(event_id % 100 AS INT) x, CAST(floor(event_id/100) AS INT) y, CAST(least(255, floor(value)) AS INT) r,
 CAST((user_id*37)%256 AS INT) g, CAST(hour(ts)*10 + floor(minute(ts)/6) AS INT) b,
 CASE event_type WHEN 'error' THEN 0 WHEN 'signup' THEN 127 WHEN 'view' THEN 128 ELSE 255 END a FROM events)"""
AXIS = "axis AS (SELECT CAST(range AS INT) v FROM range(256))"
CHS = "chs AS (SELECT unnest(['r','g','b']) ch)"


def long_of(name: str, rel: str) -> str:
    return f"{name} AS (SELECT 'r' ch, r v FROM {rel} WHERE a >= 128 UNION ALL SELECT 'g', g FROM {rel} WHERE a >= 128 UNION ALL SELECT 'b', b FROM {rel} WHERE a >= 128)"


def hist_of(name: str, longrel: str) -> str:
    return f"{name} AS (SELECT c.ch, x.v, count(l.v) n FROM chs c CROSS JOIN axis x LEFT JOIN {longrel} l ON l.ch=c.ch AND l.v=x.v GROUP BY 1,2)"


def cdf_of(name: str, hist: str) -> str:
    return f"""{name} AS (SELECT ch, v, n, CASE WHEN tot = 0 THEN 0e0 ELSE cum/CAST(tot AS DOUBLE) END c, cum, tot FROM
 (SELECT ch, v, n, CAST(sum(n) OVER (PARTITION BY ch ORDER BY v) AS BIGINT) cum, CAST(sum(n) OVER (PARTITION BY ch) AS BIGINT) tot FROM {hist}))"""


BOTH = ",\n".join([SRC, TGT, AXIS, CHS, long_of("sl", "src"), long_of("tl", "tgt"), hist_of("sh", "sl"), hist_of("th", "tl"), cdf_of("sc", "sh"), cdf_of("tc", "th")])
SPECIFY = "curves AS (SELECT t.ch, t.v, CAST(coalesce(min(s.v), 255) AS INT) o FROM tc t LEFT JOIN sc s ON s.ch=t.ch AND s.c >= t.c GROUP BY 1,2)"
WIDE = "wide AS (SELECT v, max(o) FILTER (ch='r') r, max(o) FILTER (ch='g') g, max(o) FILTER (ch='b') b FROM {0} GROUP BY v)"


def wide(rel: str = "curves", name: str = "wide") -> str:
    return WIDE.format(rel).replace("wide AS", f"{name} AS", 1)


FITTED = f"{BOTH},\n{SPECIFY},\n{wide()}"


def luma(p: str = "", s: str = "") -> str:
    return f"(2126e-4*{p}r{s} + 7152e-4*{p}g{s} + 722e-4*{p}b{s})"


def byte(e: str) -> str:
    return f"CAST(least(255, greatest(0, floor(({e}) + 5e-1))) AS INT)"


def linear(c: str) -> str:
    return f"(CASE WHEN {c}/255e0 <= 4045e-5 THEN {c}/255e0/1292e-2 ELSE pow(({c}/255e0 + 55e-3)/1055e-3, 24e-1) END)"


def lab(rel: str, keep: str) -> str:
    """A subquery of rel with l_, a_, b_ besides the kept columns."""
    f = lambda t: f"(CASE WHEN {t} > 8856e-6 THEN pow({t}, 1e0/3) ELSE 7787e-3*{t} + 16e0/116 END)"
    return f"""(SELECT {keep}, 116e0*fy - 16 l_, 500e0*(fx - fy) a_, 200e0*(fy - fz) b_ FROM (SELECT {keep}, {f('xn')} fx, {f('yn')} fy, {f('zn')} fz FROM
 (SELECT {keep}, (4124564e-7*lr + 3575761e-7*lg + 1804375e-7*lb)/95047e-5 xn, (2126729e-7*lr + 7151522e-7*lg + 721750e-7*lb)/1e0 yn, (193339e-7*lr + 1191920e-7*lg + 9503041e-7*lb)/108883e-5 zn FROM
 (SELECT *, {linear('r')} lr, {linear('g')} lg, {linear('b')} lb FROM {rel}))))"""


def hsl(rel: str, keep: str, s: str, out: str) -> str:
    """A subquery of rel with h, s, l of the columns r, g, b with suffix s, named with suffix out."""
    r, g, b = (f"({c}{s}/255e0)" for c in "rgb")
    return f"""(SELECT {keep}, CASE WHEN d = 0 THEN 0 WHEN mx = rn THEN ((gn-bn)/d + CASE WHEN gn < bn THEN 6 ELSE 0 END)/6e0 WHEN mx = gn THEN ((bn-rn)/d + 2)/6e0 ELSE ((rn-gn)/d + 4)/6e0 END h{out},
 CASE WHEN d = 0 THEN 0 WHEN (mx+mn)/2e0 > 5e-1 THEN d/(2-mx-mn) ELSE d/(mx+mn) END s{out}, (mx+mn)/2e0 l{out} FROM
 (SELECT *, mx-mn d FROM (SELECT *, {r} rn, {g} gn, {b} bn, greatest({r},{g},{b}) mx, least({r},{g},{b}) mn FROM {rel})))"""


def unhsl(h: str, s: str, l: str) -> tuple[str, str, str]:  # noqa: E741
    q = f"(CASE WHEN {l} < 5e-1 THEN {l}*(1+{s}) ELSE {l}+{s}-{l}*{s} END)"
    p = f"(2*{l}-{q})"

    def part(shift: str) -> str:
        t0 = f"({h}{shift})"
        t = f"(CASE WHEN {t0} < 0 THEN {t0}+1 WHEN {t0} > 1 THEN {t0}-1 ELSE {t0} END)"
        v = f"(CASE WHEN {t} < 1e0/6 THEN {p}+({q}-{p})*6*{t} WHEN {t} < 5e-1 THEN {q} WHEN {t} < 2e0/3 THEN {p}+({q}-{p})*(2e0/3-{t})*6 ELSE {p} END)"
        return f"floor((CASE WHEN {s} = 0 THEN {l} ELSE {v} END)*255 + 5e-1)"

    return part("+1e0/3"), part("+0"), part("-1e0/3")
