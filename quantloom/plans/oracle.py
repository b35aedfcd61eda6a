"""Equivalent SQL of the registered queries, from shared table expressions."""

from __future__ import annotations

from quantloom.operators.news import GENERAL, IMPORTANT, KEYWORDS, STOP_WORDS

ASOF_BARS, ASOF_NEWS = "2001-11-05", "2024-01-31 00:00:00"
W = "PARTITION BY symbol ORDER BY d"


def frame(k: int, before: int = 0) -> str:
    return f"({W} ROWS BETWEEN {k - 1 + before} PRECEDING AND {f'{before} PRECEDING' if before else 'CURRENT ROW'})"


def _bars(key: str, name: str) -> str:
    order = "ROW(l_orderkey, l_linenumber, l_extendedprice, l_quantity)"
    return f"{name} AS (SELECT {key} AS symbol, d, min_by(px, {order}) AS open, max(px) AS high, min(px) AS low, max_by(px, {order}) AS close, sum(l_quantity) AS volume FROM lots GROUP BY {key}, d)"


def _numbered(source: str, name: str) -> str:
    return f"{name} AS (SELECT *, row_number() OVER ({W}) AS n, count(*) OVER (PARTITION BY symbol) AS cnt, close - lag(close) OVER ({W}) AS diff FROM {source})"


def _with_rsi(source: str, name: str) -> str:
    return (
        f"{name} AS (SELECT *, CASE WHEN n < 15 THEN 50e0 WHEN loss = 0 THEN 100e0 ELSE 100e0 - 100e0 / (1e0 + gain / loss) END AS rsi FROM (SELECT *, avg(CASE WHEN diff > 0 THEN diff ELSE 0e0 END) OVER {frame(14)} AS gain, "
        f"avg(CASE WHEN diff < 0 THEN -diff ELSE 0e0 END) OVER {frame(14)} AS loss FROM {source}))"
    )


def _first(values: list[tuple[str, str]], other: str) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in values) + f" ELSE {other} END"


def _signed(expr: str) -> str:
    return f"CAST(CAST(floor({expr} * 100 + 0.5e0) AS BIGINT) AS VARCHAR)"


def _tenth(expr: str) -> str:
    return f"printf('%.1f', floor({expr} * 10 + 0.5e0) / 10)"


# Thresholds, points and texts of the rules.
TECH = [
    [("rsi < 30", 3, "'RSI oversold (<30)'"), ("rsi < 40", 2, "'RSI below 40'"), ("rsi > 70", -3, "'RSI overbought (>70)'"), ("rsi > 60", -2, "'RSI above 60'")],
    [("close > ma_20 AND ma_20 > ma_50", 2, "'Bullish MA trend'"), ("close > ma_20", 1, "'Above MA(20)'"), ("close < ma_20", -1, "'Below MA(20)'")],
    [("volume > avg_volume * 1.5e0", 1, "'High volume'")],
]
FUND = [
    [("pe > 0 AND pe < 15", 2, f"'Low P/E (' || {_tenth('pe')} || ')'"), ("pe >= 15 AND pe < 25", 1, f"'Fair P/E (' || {_tenth('pe')} || ')'"), ("pe > 35", -2, f"'High P/E (' || {_tenth('pe')} || ')'")],
    [("growth > 0.15e0", 2, f"'Strong growth (' || {_signed('growth')} || '%)'"), ("growth > 0.05e0", 1, f"'Positive growth (' || {_signed('growth')} || '%)'"), ("growth < -0.1e0", -2, f"'Declining earnings (' || {_signed('growth')} || '%)'")],
    [("margin > 0.15e0", 1, f"'High margins (' || {_signed('margin')} || '%)'")],
]
MOMENTUM = [
    [("month > 0.15e0", 3, f"'Strong 1M momentum (+' || {_signed('month')} || '%)'"), ("month > 0.05e0", 1, f"'Positive 1M trend (+' || {_signed('month')} || '%)'"), ("month < -0.15e0", -3, f"'Weak 1M momentum (' || {_signed('month')} || '%)'"), ("month < -0.05e0", -1, f"'Negative 1M trend (' || {_signed('month')} || '%)'")],
    [("week > 0.05e0", 1, f"'Weekly momentum (+' || {_signed('week')} || '%)'"), ("week < -0.05e0", -1, f"'Weekly decline (' || {_signed('week')} || '%)'")],
]


def _score(groups: list) -> str:
    return " + ".join(_first([(c, str(v)) for c, v, _ in g], "0") for g in groups)


def _reasons(groups: list, k: int) -> str:
    listed = ", ".join(_first([(c, r) for c, _, r in g], "NULL") for g in groups)
    return f"coalesce(array_to_string(list_filter([{listed}], lambda x: x IS NOT NULL)[1:{k}], '; '), '')"


PARTS = {
    "lots": "lots AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_returnflag, CAST(l_shipdate AS DATE) AS d, 100 + floor(l_extendedprice / l_quantity + 0.5e0) / 100 AS px FROM lineitem)",
    "bars": _bars("l_suppkey", "bars"),
    "shorts": _bars("l_partkey", "shorts"),
    "num": _numbered("bars", "num"),
    "snum": _numbered("shorts", "snum"),
    "r": _with_rsi("num", "r"),
    "sr": _with_rsi("snum", "sr"),
    "ind": f"ind AS (SELECT *, CASE WHEN n >= 20 THEN avg(close) OVER {frame(20)} ELSE close END AS ma_20, CASE WHEN n >= 50 THEN avg(close) OVER {frame(50)} ELSE close END AS ma_50 FROM r)",
    "back": "back AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY d DESC) AS b FROM bars)",
    "recent": "recent AS (SELECT symbol, max(CASE WHEN b = 1 THEN close END) AS last, max(CASE WHEN b = 2 THEN close END) AS prev, max(CASE WHEN b = 1 THEN volume END) AS volume, max(high) AS hi, min(low) AS lo FROM back WHERE b <= 252 GROUP BY symbol)",
    "q": (
        "q AS (SELECT s_suppkey AS symbol, s_name AS name, CASE WHEN s_suppkey % 5 <> 0 THEN last END AS cur, CASE WHEN s_suppkey % 10 <> 0 THEN last END AS reg, (last / prev - 1) * 100 AS change, volume, s_acctbal * 1e6 AS mcap, "
        "CASE WHEN s_suppkey % 9 <> 0 THEN s_acctbal / 200 END AS pe, s_acctbal / 1e3 AS eps, CASE WHEN s_suppkey % 7 <> 0 THEN (s_suppkey * 23 % 40) / 1e1 - 0.5e0 END AS peg, "
        "CASE WHEN s_suppkey % 11 <> 0 THEN (s_suppkey * 37 % 61 - 20) / 1e2 END AS growth, CASE WHEN s_suppkey % 13 <> 0 THEN (s_suppkey * 17 % 41 - 10) / 1e2 END AS margin, CASE WHEN s_suppkey % 3 <> 0 THEN (s_suppkey % 6) / 1e2 END AS yield, hi, lo, "
        "r_name AS sector, n_name AS industry, CASE WHEN s_suppkey % 8 <> 0 THEN s_suppkey * 100 END AS staff FROM supplier LEFT JOIN recent ON symbol = s_suppkey LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey)"
    ),
    "pos": "pos AS (SELECT o_custkey AS portfolio_id, l_suppkey AS symbol, l_quantity AS shares, px AS buy_price FROM lots JOIN orders ON l_orderkey = o_orderkey)",
    "val": (
        "val AS (SELECT pos.*, q.symbol IS NOT NULL AS counted, coalesce(cur, reg, buy_price) AS price, coalesce(cur, reg, buy_price) * shares AS value, buy_price * shares AS cost FROM pos LEFT JOIN q ON q.symbol = pos.symbol WHERE shares >= 0.001e0)"
    ),
    "watch": "watch AS (SELECT DISTINCT o_custkey AS portfolio_id, l_suppkey AS symbol FROM lots JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R')",
    "s63": "s63 AS (SELECT * EXCLUDE (b) FROM back WHERE b <= 63)",
    "s63n": _numbered("s63", "s63n"),
    "s63r": _with_rsi("s63n", "s63r"),
    "s63m": f"s63m AS (SELECT *, CASE WHEN n >= 50 THEN avg(close) OVER {frame(50)} ELSE ma_20 END AS ma_50, CASE WHEN n >= 10 THEN avg(volume) OVER {frame(10)} ELSE volume END AS avg_volume, CASE WHEN n > 4 THEN (close - lag(close, 4) OVER ({W})) / lag(close, 4) OVER ({W}) ELSE 0e0 END AS week, CASE WHEN n > 19 THEN (close - lag(close, 19) OVER ({W})) / lag(close, 19) OVER ({W}) ELSE 0e0 END AS month FROM (SELECT *, CASE WHEN n >= 20 THEN avg(close) OVER {frame(20)} ELSE close END AS ma_20 FROM s63r))",
    "last": "last AS (SELECT s63m.*, q.name, q.pe, q.growth, q.margin FROM s63m LEFT JOIN q ON q.symbol = s63m.symbol WHERE n = cnt AND cnt >= 20)",
    "scan": f"scan AS (SELECT *, t + f + m AS total FROM (SELECT *, {_score(TECH)} AS t, {_score(FUND)} AS f, {_score(MOMENTUM)} AS m FROM last))",
    "sig": (
        "sig AS (SELECT *, CASE WHEN price IS NULL THEN NULL ELSE CASE WHEN rsi < 40 THEN 2 WHEN rsi > 60 THEN -2 ELSE 0 END + CASE WHEN price > ma_20 THEN 1 ELSE 0 END + CASE WHEN price > ma_50 THEN 1 ELSE 0 END END AS score FROM "
        "(SELECT ind.*, coalesce(q.cur, q.reg) AS price, q.pe FROM ind LEFT JOIN q ON q.symbol = ind.symbol WHERE n = cnt))"
    ),
    "art": (
        f"art AS (SELECT doc_id AS article_id, split_part(text, chr(10), 1) AS title, CASE WHEN doc_id % 3 = 0 THEN '<p>' || text || '</p>' ELSE text END AS description, "
        f"CASE WHEN doc_id % 19 <> 0 THEN source END AS source_name, CASE WHEN doc_id % 23 <> 0 THEN TIMESTAMP '{ASOF_NEWS}' - to_hours(CAST(doc_id % 400 AS INTEGER)) END AS pub, doc_id % 400 AS hours, CASE WHEN doc_id % 2 = 0 THEN 'primary' ELSE 'backup' END AS feed, doc_id AS pos, lang, "
        f"CASE WHEN doc_id % 23 = 0 THEN 'unknown' WHEN doc_id % 4 = 1 THEN strftime(TIMESTAMP '{ASOF_NEWS}' - to_hours(CAST(doc_id % 400 AS INTEGER)), '%a, %d %b %Y %H:%M:%S GMT') ELSE strftime(TIMESTAMP '{ASOF_NEWS}' - to_hours(CAST(doc_id % 400 AS INTEGER)), '%Y-%m-%dT%H:%M:%SZ') END AS published_at FROM documents)"
    ),
    "raw": (
        "raw AS (SELECT symbol, d, open, CASE WHEN h = 11 THEN low - 1 ELSE high END AS high, low, CASE WHEN h = 3 THEN NULL WHEN h = 5 THEN 'nan'::DOUBLE WHEN h = 7 THEN -close ELSE close END AS close, CASE WHEN h = 13 THEN -1e0 ELSE volume END AS volume, h "
        "FROM (SELECT *, (symbol * 31 + (d - DATE '1970-01-01')) % 97 AS h FROM bars) UNION ALL SELECT symbol, d, open, high, low, close + 1, volume, 1000 FROM bars WHERE (symbol * 31 + (d - DATE '1970-01-01')) % 97 = 17)"
    ),
    "ticks": "ticks AS (SELECT user_id AS symbol, ts, value AS price, event_id FROM events)",
}
NEEDS = {
    "bars": ["lots"], "shorts": ["lots"], "num": ["bars"], "snum": ["shorts"], "r": ["num"], "sr": ["snum"], "ind": ["r"], "back": ["bars"], "raw": ["bars"], "recent": ["back"], "q": ["recent"], "pos": ["lots"],
    "val": ["pos", "q"], "watch": ["lots"], "s63": ["back"], "s63n": ["s63"], "s63r": ["s63n"], "s63m": ["s63r"], "last": ["s63m", "q"], "scan": ["last"], "sig": ["ind", "q"],
}


def sql(names: str, body: str, more: str = "", recursive: bool = False) -> str:
    """WITH the named parts and what they need, and any more, followed by the body."""
    order: list[str] = []

    def need(n: str) -> None:
        for x in NEEDS.get(n, []):
            need(x)
        if n not in order:
            order.append(n)

    for n in names.split():
        need(n)
    parts = [PARTS[n] for n in order] + ([more] if more else [])
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(parts) + "\n" + body


def query_rows(rows: list[tuple[str, int]]) -> str:
    """qs(query, count, keywords), with keywords by the route."""
    text = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({text(q)}, {n})" for q, n in rows)
    return f"qs AS (SELECT query, count, {keyword_sql('category')} AS keywords FROM (SELECT query, count, {route_sql('query')} AS category FROM (VALUES {values}) v(query, count)))"


def route_sql(c: str) -> str:
    low = f"lower({c})"
    rules = [("technology stocks", "technology"), ("healthcare", "healthcare"), ("energy", "energy")]
    cases = [(f"contains({low}, '{a}')", f"'{b}'") for a, b in rules]
    cases += [(f"contains({low}, 'banking') OR contains({low}, 'finance stocks')", "'banking'"), (f"contains({low}, 'mergers')", "'mergers'"), (f"contains({low}, 'food')", "'food'"), (f"contains({low}, 'financial markets') OR {low} = 'all'", "'general'")]
    return _first(cases, f"'symbol:' || split_part(trim(replace(upper({c}), ' STOCK', '')), ' ', 1)")


def keyword_sql(c: str) -> str:
    return _first([(f"starts_with({c}, 'symbol:')", f"[lower(substr({c}, 8))]")] + [(f"{c} = '{k}'", "[" + ", ".join(f"'{w}'" for w in v) + "]") for k, v in KEYWORDS.items()], "NULL")


MATCH = "(keywords IS NULL OR len(list_filter(keywords, lambda k: contains(lower(coalesce(title, '')), k) OR contains(lower(coalesce(description, '')), k))) > 0)"
RECENT = f"(pub IS NULL OR pub >= TIMESTAMP '{ASOF_NEWS}' - INTERVAL 7 DAY)"
STOP = "[" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "]"


def similarity_parts(articles: str) -> str:
    """sim(query, article_id, similarity) of all pairs of qs and the articles."""
    return f"""
at_(article_id, term, ta) AS (SELECT article_id, term, count(*) FROM (SELECT article_id, unnest(regexp_extract_all(lower(concat_ws(' ', title, coalesce(description, ''))), '[a-z0-9_]{{2,}}')) AS term FROM {articles}) WHERE NOT list_contains({STOP}, term) GROUP BY ALL),
qt(query, term, tq) AS (SELECT query, term, count(*) FROM (SELECT query, unnest(regexp_extract_all(lower(query), '[a-z0-9_]{{2,}}')) AS term FROM (SELECT DISTINCT query FROM qs)) WHERE NOT list_contains({STOP}, term) GROUP BY ALL),
pr AS (SELECT DISTINCT query, article_id FROM qs CROSS JOIN {articles}),
bt AS (SELECT query, article_id, term, sum(ta) AS ta, sum(tq) AS tq FROM (SELECT query, article_id, term, ta, 0 AS tq FROM at_ CROSS JOIN (SELECT DISTINCT query FROM qs) UNION ALL SELECT query, article_id, term, 0, tq FROM qt CROSS JOIN (SELECT DISTINCT article_id FROM {articles})) GROUP BY ALL),
kt AS (SELECT *, CASE WHEN ta > 0 AND tq > 0 THEN 1e0 ELSE ln(1.5e0) + 1 END AS w FROM (SELECT *, row_number() OVER (PARTITION BY query, article_id ORDER BY ta + tq DESC, term) AS k FROM bt) WHERE k <= 100),
nm AS (SELECT query, article_id, sum(ta * tq) AS dot, sum((ta * w) ** 2) AS na, sum((tq * w) ** 2) AS nq FROM kt GROUP BY ALL),
sim AS (SELECT pr.query, pr.article_id, coalesce(CASE WHEN na > 0 AND nq > 0 THEN dot / (sqrt(na) * sqrt(nq)) ELSE 0e0 END, 0e0) AS similarity FROM pr LEFT JOIN nm ON nm.query = pr.query AND nm.article_id = pr.article_id),
rel AS (SELECT sim.query, sim.article_id, similarity, title, pos, CASE WHEN title IS NULL THEN 0.5e0 ELSE similarity
  + 0.2e0 * len(list_filter(regexp_split_to_array(lower(sim.query), '\\s+'), lambda w: length(w) > 3 AND contains(lower(title), w)))
  + 0.1e0 * len(list_filter([{", ".join(f"'{w}'" for w in IMPORTANT)}], lambda w: contains(lower(title), w)))
  + coalesce(CASE WHEN pub IS NULL THEN NULL WHEN floor(hours / 24e0) <= 1 THEN 0.3e0 WHEN floor(hours / 24e0) <= 3 THEN 0.2e0 END, 0e0) END AS relevance
  FROM sim JOIN {articles} a ON a.article_id = sim.article_id)"""


GENERAL_SQL = ", ".join(f"'{g}'" for g in GENERAL)
