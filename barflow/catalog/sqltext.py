"""Small text helpers for writing window SQL in the oracles."""

P = "PARTITION BY symbol ORDER BY dt"
PD = "PARTITION BY symbol, trade_date ORDER BY dt"


def roll(fn, x, n, need=None):
    w = f"({P} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) OVER {w} >= {need or n} THEN {fn}({x}) OVER {w} END"


def lag(x, n=1):
    return f"lag({x}, {n}) OVER ({P})"


def diff(x, n=1):
    return f"({x} - {lag(x, n)})"


def change(x, n=1):
    return f"({x} / {lag(x, n)} - 1)"


def over(fn, start, end):
    return f"{fn} OVER ({P} ROWS BETWEEN {start} AND {end})"


def day(fn):
    return f"{fn} OVER ({PD} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def flag(cond):
    return f"CASE WHEN {cond} THEN 1 ELSE 0 END"


TR = f"greatest(high-low, coalesce(abs(high-{lag('close')}), high-low), coalesce(abs(low-{lag('close')}), high-low))"
TP = "((high+low+close)/3)"


def stages(base, *steps):
    """CTE chain: each step adds columns to the previous one; returns (text, last name)."""
    prev, parts = base, []
    for i, cols in enumerate(steps):
        name = f"s{i}"
        parts.append(f"{name} AS (SELECT *, " + ", ".join(f"{e} AS {c}" for c, e in cols.items()) + f" FROM {prev})")
        prev = name
    return ",\n".join(parts), prev


def ema_sql(source, key_columns, emas, extra=""):
    """Recursive CTE ``e`` with one EMA column per (name, expression, span), over ``source`` numbered by ``rn``."""
    first = ", ".join(f"{x} AS {n}" for n, x, _ in emas)
    step = ", ".join(f"e.{n}*(1-2e0/({s}+1)) + n.{x}*(2e0/({s}+1)) AS {n}" for n, x, s in emas)
    keys = ", ".join(key_columns)
    nk = ", ".join(f"n.{k}" for k in key_columns)
    return (f"num AS (SELECT *, row_number() OVER ({P}) AS rn FROM {source}),\n"
            f"e AS (SELECT {keys}, rn, {first} FROM num WHERE rn = 1 UNION ALL "
            f"SELECT {nk}, n.rn, {step} FROM e JOIN num n ON n.symbol = e.symbol AND n.rn = e.rn + 1)")


def expand_rsi(name, n, d="d"):
    g, l = f"greatest({d},0)", f"greatest(-{d},0)"
    g = f"CASE WHEN {d} IS NOT NULL THEN {g} END"
    l = f"CASE WHEN {d} IS NOT NULL THEN {l} END"
    return {name: f"100-100/(1+({roll('avg', f'({g})', n)})/(({roll('avg', f'({l})', n)})+1e-10))"}
