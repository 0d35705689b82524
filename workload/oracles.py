"""SQL side of the checked queries (DuckDB dialect), written from the definitions.

Plain windows and joins, no attempt at scale: this is the statement of what must come out.
"""

from __future__ import annotations

import re

from adlens.schema import NA_TOKENS
from workload.forest_sql import forest_forecast, forest_stats

_MONEY = "CAST(value AS DECIMAL(18,2))"

_EVENT_MEASURES = f"""
  CAST(sum(CASE WHEN event_type IN ('view','click') THEN {_MONEY} ELSE 0 END) AS DOUBLE) AS "Spend",
  CAST(100 * count(*) FILTER (event_type = 'view') AS DOUBLE) AS "Impressions",
  CAST(count(*) FILTER (event_type = 'click') AS DOUBLE) AS "Clicks",
  CAST(count(*) FILTER (event_type = 'purchase') AS DOUBLE) AS "Conversions",
  CAST(sum(CASE WHEN event_type = 'purchase' THEN {_MONEY} ELSE 0 END) AS DOUBLE) AS "Revenue"
"""


def _events(campaigns: int, channel: str) -> str:
    return f"""SELECT concat('c_', user_id % {campaigns}) AS campaign_id,
  CAST(ts AS DATE) AS "Date", {channel} AS "Channel", {_EVENT_MEASURES}
FROM events GROUP BY 1, 2, 3"""


def _ratio(top: str, bottom: str) -> str:
    return f"CASE WHEN {bottom} > 0 THEN {top} / {bottom} ELSE 0.0::DOUBLE END"


def _r(expression: str, name: str, digits: int = 6) -> str:
    scale = f"{10**digits}.0::DOUBLE"
    return f'round_even(({expression}) * {scale} - 0.01::DOUBLE, 0) / {scale} + 0.0::DOUBLE AS "{name}"'


def _rs(names: str, digits: int = 6, table: str = "") -> str:
    return ", ".join(_r(f'{table}"{n}"', n, digits) for n in names.split())


_NA = ", ".join("'" + t + "'" for t in NA_TOKENS)
_MEASURES = "Spend Impressions Clicks Conversions Revenue"


def _reading(c: str) -> str:
    return f"""greatest(coalesce(CASE WHEN (SELECT bool_or({c} IS NOT NULL AND TRY_CAST({c} AS DOUBLE) IS NULL)
    FROM tokens) THEN TRY_CAST(regexp_replace({c}, '[^0-9.]', '', 'g') AS DOUBLE)
    ELSE TRY_CAST({c} AS DOUBLE) END, 0.0::DOUBLE), 0.0::DOUBLE)"""


def _is_text(c: str) -> str:
    return f"(SELECT bool_or({c} IS NOT NULL AND TRY_CAST({c} AS DOUBLE) IS NULL) FROM tokens)"


def _signed(c: str) -> str:
    return f"""greatest(coalesce(TRY_CAST(regexp_replace({c}, '[$ ,]', '', 'g') AS DOUBLE),
    0.0::DOUBLE), 0.0::DOUBLE)"""


_TITLE = r"""array_to_string(list_transform(regexp_extract_all(lower(regexp_replace(
  coalesce(channel_raw, 'nan'), '^\s+|\s+$', '', 'g')), '(\p{L}+|[^\p{L}]+)', 1),
  lambda t: concat(upper(t[1]), t[2:])), '')"""

_SPACE = r"[\t-\r \x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _strip(text: str) -> str:
    return f"regexp_replace({text}, '^{_SPACE}+|{_SPACE}+$', '', 'g')"


def _bold(text: str) -> str:
    return rf"regexp_replace(regexp_replace({text}, '\*\*', '<b>'), '\*\*', '</b>')"


def _money(x: str) -> str:
    return f"concat('$', format('{{:,.2f}}', round({x}, 6)))"


def _money_plain(x: str) -> str:
    return f"concat('$', format('{{:.2f}}', round({x}, 6)))"


def _x(x: str) -> str:
    return f"concat(format('{{:.2f}}', round({x}, 6)), 'x')"


def _pct(x: str) -> str:
    return f"concat(CASE WHEN {x} >= 0 THEN '+' ELSE '' END, format('{{:.1f}}', round({x}, 6)), '%')"


def _growth(new: str, old: str) -> str:
    return f"CASE WHEN {old} > 0 THEN ({new} - {old}) / {old} * 100.0 ELSE 0.0::DOUBLE END"


def _curves(facts: str) -> str:
    def alpha(y: str) -> str:
        top, bottom = f'sum("{y}" * ln("Spend" + 1))', 'sum(ln("Spend" + 1) * ln("Spend" + 1))'
        return f"greatest({_ratio(top, bottom)}, 0.0::DOUBLE)"

    return f"""SELECT campaign_id, "Channel", {alpha("Revenue")} AS alpha_rev,
  {alpha("Conversions")} AS alpha_conv, {alpha("Clicks")} AS alpha_clicks,
  {alpha("Impressions")} AS alpha_imp, avg("Spend") AS avg_spend, avg("Revenue") AS avg_revenue,
  avg("Conversions") AS avg_conversions FROM {facts} GROUP BY 1, 2"""


def _channel_rows(facts: str) -> str:
    return f"""SELECT campaign_id, "Channel", s AS spend, r AS revenue, i AS impressions,
  k AS clicks, c AS conversions, {_ratio("r", "s")} AS roas, {_ratio("c", "k")} AS conv_rate,
  {_ratio("s", "c")} AS cpa, {_ratio("s", "k")} AS cpc
FROM (SELECT campaign_id, "Channel", sum("Spend") s, sum("Revenue") r, sum("Impressions") i,
  sum("Clicks") k, sum("Conversions") c FROM {facts} GROUP BY 1, 2)"""


def _kpis(facts: str) -> str:
    return f"""SELECT *, {_ratio('"Clicks"', '"Impressions"')} AS "CTR",
  {_ratio('"Spend"', '"Clicks"')} AS "CPC", {_ratio('"Spend"', '"Conversions"')} AS "CPA",
  {_ratio('"Revenue"', '"Spend"')} AS "ROAS", {_ratio('"Conversions"', '"Clicks"')} AS "ConvRate"
FROM {facts}"""


def _featured(kpis: str) -> str:
    return f"""SELECT *, month("Date")::BIGINT AS "Month", quarter("Date")::BIGINT AS "Quarter",
  CASE WHEN strftime("Date", '%m-%d') IN ('07-04','11-25','11-29','12-25') THEN 1 ELSE 0 END::BIGINT
    AS "HolidayFlag",
  avg("Spend") OVER seven AS "Spend_MA7", avg("ROAS") OVER seven AS "ROAS_MA7",
  lag("Spend", 7, 0.0::DOUBLE) OVER series AS "Spend_Lag7",
  lag("Revenue", 7, 0.0::DOUBLE) OVER series AS "Revenue_Lag7"
FROM {kpis}
WINDOW series AS (PARTITION BY campaign_id, "Channel" ORDER BY "Date"),
  seven AS (PARTITION BY campaign_id, "Channel" ORDER BY "Date" ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)"""


def _ranked(rows: str) -> str:
    return f"""SELECT *, row_number() OVER (PARTITION BY campaign_id
    ORDER BY roas DESC, md5("Channel"), "Channel") AS rank,
  count(*) OVER (PARTITION BY campaign_id) AS n FROM {rows}"""


def _extremes(ranked: str) -> str:
    return f"""SELECT campaign_id,
  max(CASE WHEN rank = 1 THEN "Channel" END) AS best_channel,
  max(CASE WHEN rank = 1 THEN roas END) AS best_roas,
  max(CASE WHEN rank = 1 THEN spend END) AS best_spend,
  coalesce(max(CASE WHEN rank = n AND n > 1 THEN "Channel" END), 'None') AS worst_channel,
  coalesce(max(CASE WHEN rank = n AND n > 1 THEN roas END), 0.0::DOUBLE) AS worst_roas
FROM {ranked} GROUP BY 1"""


_FULL_TIER = """CASE WHEN roas >= 3.0 THEN 'Highly Efficient' WHEN roas >= 2.0 THEN 'Efficient'
  WHEN roas >= 1.5 THEN 'Moderate' ELSE 'Underperforming' END"""

_BASIC_TIER = """CASE WHEN roas >= 2.5 THEN 'Highly Efficient' WHEN roas >= 1.5 THEN 'Moderately Efficient'
  ELSE 'Underperforming' END"""

_PRICE = "CAST(l_extendedprice AS DECIMAL(12,2))"

_FORECAST_NUMBERS = _rs(
    _MEASURES + " ROAS Revenue_Lower Revenue_Upper Conversions_Lower Conversions_Upper"
)

_CTES = {
    "channel_facts": _events(3, "concat('ch_', user_id % 5)"),
    "user_facts": _events(10, "concat('u_', user_id)"),
    "short_facts": _events(
        3,
        "concat('u_', user_id, CASE WHEN user_id % 10 = 0 THEN concat('_', "
        "date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) // 4) ELSE '' END)",
    ),
    "segment_facts": f"""SELECT concat('orders_', o_orderstatus) AS campaign_id, CAST(o_orderdate AS DATE) AS "Date",
  c_mktsegment AS "Channel",
  CAST(sum({_PRICE} * CAST(l_discount AS DECIMAL(4,2))) AS DOUBLE) AS "Spend",
  CAST(sum(l_quantity) AS DOUBLE) AS "Impressions", CAST(count(*) AS DOUBLE) AS "Clicks",
  CAST(count(DISTINCT o_orderkey) AS DOUBLE) AS "Conversions",
  CAST(sum({_PRICE}) AS DOUBLE) AS "Revenue"
FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey
GROUP BY 1, 2, 3""",
    "dirty": """SELECT event_id,
  CASE WHEN event_id % 97 = 0 THEN 'not a date' WHEN event_id % 89 = 0 THEN '06/02/2024'
    ELSE strftime(CAST(ts AS DATE), '%Y-%m-%d') END AS date_raw,
  CASE WHEN event_id % 53 = 0 THEN NULL WHEN event_id % 2 = 0 THEN concat('  web-', user_id % 5, 'go ')
    ELSE concat('WEB-', user_id % 5, 'GO') END AS channel_raw,
  CASE WHEN event_id % 31 = 0 THEN 'N/A' WHEN event_id % 29 = 0 THEN concat('-', v)
    WHEN event_id % 7 = 0 THEN concat('$1,', v) ELSE v END AS spend,
  CASE WHEN event_type = 'view' THEN '100' ELSE '0' END AS impressions,
  CASE WHEN event_id % 29 = 0 THEN '-5' WHEN event_id % 31 = 0 THEN ''
    ELSE CAST(user_id AS VARCHAR) END AS clicks,
  CASE WHEN event_type = 'purchase' THEN '1' ELSE '0' END AS conversions,
  CASE WHEN event_type = 'purchase' THEN v ELSE '0' END AS revenue
FROM (SELECT *, CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR) AS v FROM events)""",
    "tokens": f"""SELECT event_id, TRY_CAST(try_strptime(date_raw, '%Y-%m-%d') AS DATE) AS "Date",
  {_TITLE} AS "Channel",
  {", ".join(f"CASE WHEN {c} NOT IN ({_NA}) THEN {c} END AS {c}"
             for c in _MEASURES.lower().split())}
FROM dirty""",
    "clean_rows": f"""SELECT event_id, "Date", "Channel",
  {", ".join(f'{_reading(c.lower())} AS "{c}"' for c in _MEASURES.split())} FROM tokens""",
    "merged": f"""SELECT 'dirty' AS campaign_id, "Date", "Channel",
  {", ".join(f'sum("{c}") AS "{c}"' for c in _MEASURES.split())}
FROM clean_rows WHERE "Date" IS NOT NULL GROUP BY 1, 2, 3""",
    "segment_dates": """SELECT *, dense_rank() OVER (PARTITION BY campaign_id ORDER BY "Date" DESC)
  AS back FROM segment_facts""",
    "channel_kpis": _kpis("channel_facts"),
    "user_kpis": _kpis("user_facts"),
    "segment_kpis": _kpis("segment_facts"),
    "short_kpis": _kpis("short_facts"),
    "user_featured": _featured("user_kpis"),
    "segment_featured": _featured("segment_kpis"),
    "channel_featured": _featured("channel_kpis"),
    "dated": f"""SELECT concat('way_', user_id % 5) AS campaign_id, event_type,
  concat('Ch ', event_id % 4) AS "Channel", CAST({_MONEY} AS DOUBLE) AS spend,
  CASE WHEN event_id % 41 = 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S')
    WHEN event_id % 43 = 0 THEN 'no date'
    ELSE CASE user_id % 5 WHEN 0 THEN strftime(ts, '%Y-%m-%d')
      WHEN 1 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') WHEN 2 THEN strftime(ts, '%m/%d/%Y')
      WHEN 3 THEN strftime(ts, '%d/%m/%Y') ELSE strftime(ts, '%Y/%m/%d') END END AS raw
FROM events""",
    "chosen_way": """SELECT campaign_id, name, n FROM (SELECT *, row_number() OVER (
  PARTITION BY campaign_id ORDER BY n DESC, preference) AS place FROM way_counts) WHERE place = 1""",
    "streamed_kpis": _kpis("merged"),
    "streamed_featured": _featured("streamed_kpis"),
    "short_last": """SELECT *, count(*) OVER (PARTITION BY campaign_id, "Channel") AS n,
  row_number() OVER (PARTITION BY campaign_id, "Channel" ORDER BY "Date" DESC) AS back
FROM short_kpis""",
    "flat_rows": """SELECT campaign_id, "Channel", CAST("Date" + CAST(d AS INTEGER) AS DATE) AS "Date",
  "Spend", "Impressions", "Clicks", "Conversions", "Revenue", "ROAS",
  "Revenue" * 0.9::DOUBLE AS "Revenue_Lower", "Revenue" * 1.1::DOUBLE AS "Revenue_Upper",
  "Conversions" * 0.9::DOUBLE AS "Conversions_Lower",
  "Conversions" * 1.1::DOUBLE AS "Conversions_Upper", true AS "IsForecast", n
FROM short_last, range(1, 31) AS days(d) WHERE back = 1""",
    "old_rows": """SELECT campaign_id, "Channel", "Date", "Spend", "Impressions", "Clicks",
  "Conversions", "Revenue", "ROAS", "Revenue" AS "Revenue_Lower", "Revenue" AS "Revenue_Upper",
  "Conversions" AS "Conversions_Lower", "Conversions" AS "Conversions_Upper",
  false AS "IsForecast" FROM short_kpis""",
    "flat_forecast": """SELECT * FROM old_rows UNION ALL SELECT * EXCLUDE (n) FROM flat_rows""",
    "flat_dates": """SELECT *, dense_rank() OVER (PARTITION BY campaign_id, "IsForecast"
  ORDER BY "Date" DESC) AS back FROM flat_forecast""",
    "flat_sums": """SELECT campaign_id,
  sum("Spend") FILTER (NOT "IsForecast" AND back <= 30) AS historical_spend,
  sum("Revenue") FILTER (NOT "IsForecast" AND back <= 30) AS historical_revenue,
  sum("Conversions") FILTER (NOT "IsForecast" AND back <= 30) AS historical_conversions,
  sum("Spend") FILTER ("IsForecast") AS projected_spend,
  sum("Revenue") FILTER ("IsForecast") AS projected_revenue,
  sum("Conversions") FILTER ("IsForecast") AS projected_conversions
FROM flat_dates GROUP BY 1""",
    "flat_summary": f"""SELECT *, {_ratio("historical_revenue", "historical_spend")} AS historical_roas,
  {_ratio("projected_revenue", "projected_spend")} AS projected_roas FROM flat_sums""",
    "flat_trend": f"""SELECT *,
  CASE WHEN projected_roas > historical_roas THEN 'improving'
    WHEN abs(projected_roas - historical_roas) < 0.1 THEN 'stable' ELSE 'declining' END AS trend,
  {_growth("projected_revenue", "historical_revenue")} AS revenue_growth,
  {_growth("projected_spend", "historical_spend")} AS spend_growth,
  projected_roas >= 1.5 AS is_healthy FROM flat_summary""",
    "short_channels": _channel_rows("short_facts"),
    "user_channels": _channel_rows("user_facts"),
    "short_ranked": _ranked("short_channels"),
    "user_ranked": _ranked("user_channels"),
    "short_extremes": _extremes("short_ranked"),
    "channel_curves": _curves("channel_facts"),
    "user_curves": _curves("user_facts"),
    "segment_curves": _curves("segment_facts"),
    "budgets": """SELECT concat('c_', s_suppkey % 3) AS campaign_id, s_name AS scenario_id,
  concat('ch_', s_suppkey % 7) AS "Channel", abs(s_acctbal) AS budget FROM supplier""",
    "scenario_spend": """SELECT c.*, s.scenario_id, coalesce(b.budget, c.avg_spend) AS x
FROM channel_curves c JOIN (SELECT DISTINCT campaign_id, scenario_id FROM budgets) s
  ON s.campaign_id = c.campaign_id
LEFT JOIN budgets b ON b.campaign_id = c.campaign_id AND b.scenario_id = s.scenario_id
  AND b."Channel" = c."Channel" """,
    "outcome": """SELECT campaign_id, scenario_id, "Channel", x AS "Spend",
  alpha_imp * ln(x + 1) AS "Impressions", alpha_clicks * ln(x + 1) AS "Clicks",
  alpha_conv * ln(x + 1) AS "Conversions", alpha_rev * ln(x + 1) AS "Revenue" FROM scenario_spend""",
    "outcome_totals": f"""SELECT campaign_id, scenario_id, sum("Spend") AS "TotalSpend",
  sum("Revenue") AS "TotalRevenue", sum("Conversions") AS "TotalConversions",
  {_ratio('sum("Revenue")', 'sum("Spend")')} AS "TotalROAS" FROM outcome GROUP BY 1, 2""",
    "channel_base": """SELECT campaign_id, "Channel", false AS is_total, avg_spend AS "Spend",
  avg_conversions AS "Conversions", avg_revenue AS "Revenue" FROM channel_curves
UNION ALL SELECT campaign_id, 'Total', true, sum(avg_spend), sum(avg_conversions), sum(avg_revenue)
FROM channel_curves GROUP BY 1""",
    "user_budget": """SELECT campaign_id, floor(round(sum(avg_spend), 6) + 0.5) AS b FROM user_curves GROUP BY 1""",
    "thousand": "SELECT DISTINCT campaign_id, 1000.0::DOUBLE AS b FROM channel_curves",
    "conversation_messages": """SELECT concat(conv_id, '-', turn) AS message_id,
  concat('c_', conv_id % 3) AS campaign_id,
  concat(text, CASE (conv_id + turn) % 5 WHEN 0 THEN ' Optimize my BUDGET forecast'
    WHEN 1 THEN ' What about next month ROAS?' WHEN 2 THEN ' Which return do I get?'
    WHEN 3 THEN ' Which channel should I invest in?' ELSE '' END) AS text FROM conversations""",
    "routed": """SELECT *, CASE
  WHEN lower(text) LIKE '%optimize%' OR lower(text) LIKE '%budget%' OR lower(text) LIKE '%allocation%'
    THEN 'allocation'
  WHEN lower(text) LIKE '%forecast%' OR lower(text) LIKE '%future%' OR lower(text) LIKE '%next month%'
    THEN 'forecast'
  WHEN lower(text) LIKE '%roas%' OR lower(text) LIKE '%return%' THEN 'return'
  ELSE 'default' END AS intent FROM conversation_messages""",
}


def _split_of(curves: str, budget: str) -> str:
    """Water-filling: the active channels are a prefix by descending alpha."""
    return f"""ladder AS (SELECT c.campaign_id, c."Channel", c.alpha_rev, t.b,
    row_number() OVER w AS k, sum(c.alpha_rev) OVER w AS s
  FROM {curves} c JOIN {budget} t ON t.campaign_id = c.campaign_id
  WINDOW w AS (PARTITION BY c.campaign_id ORDER BY c.alpha_rev DESC, c."Channel"
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
steps AS (SELECT *, s / (b + k) AS lambda_k, alpha_rev > s / (b + k) AS active FROM ladder),
levels AS (SELECT campaign_id, max(CASE WHEN active THEN k END) AS n, count(*) AS m,
  sum(alpha_rev) AS total_alpha FROM steps GROUP BY 1),
lambdas AS (SELECT l.*, s.lambda_k FROM levels l LEFT JOIN steps s
  ON s.campaign_id = l.campaign_id AND s.k = l.n),
shares AS (SELECT s.campaign_id, s."Channel", s.b, CASE WHEN s.b <= 0 THEN 0.0::DOUBLE
    WHEN l.total_alpha = 0 THEN s.b / l.m
    ELSE greatest(0.0::DOUBLE, s.alpha_rev / l.lambda_k - 1) END AS raw
  FROM steps s JOIN lambdas l ON l.campaign_id = s.campaign_id),
split AS (SELECT campaign_id, "Channel", b AS total_budget,
  CASE WHEN sum(raw) OVER (PARTITION BY campaign_id) > 0
    THEN raw / sum(raw) OVER (PARTITION BY campaign_id) * b ELSE raw END AS budget FROM shares)"""


def _lines(section: int, source: str, texts: list[str], first: str = "0") -> str:
    return " UNION ALL ".join(
        f"SELECT campaign_id, {section}::BIGINT AS section, ({first} + {i})::BIGINT AS line, "
        f"{text} AS text FROM {source}"
        for i, text in enumerate(texts)
    )


_NARRATIVE = " UNION ALL ".join(
    [
        _lines(1, "flat_trend", [
            "'## Forecast against history'",
            "concat('Efficiency trend: ', trend)",
            f"concat('- Revenue: ', {_money('projected_revenue')}, ' ahead, ', "
            f"{_pct('revenue_growth')}, ' on what was measured')",
            f"concat('- Spend: ', {_money('projected_spend')}, ' ahead, ', {_pct('spend_growth')})",
            f"concat('- ROAS: ', {_x('historical_roas')}, ' measured, ', {_x('projected_roas')}, ' ahead')",
            "concat('Health: ', CASE WHEN is_healthy THEN 'ok' ELSE 'below bound' END, "
            "'; growth class: ', CASE WHEN revenue_growth > 10 THEN "
            "'steady growth' ELSE 'marginal returns' END)",
        ]),
        _lines(2, "flat_summary", ["'## Channels by ROAS'"]),
        _lines(3, "short_ranked", [
            "concat('### ', \"Channel\")",
            f"concat('- ', {_x('roas')}, ' on ', {_money('spend')}, ', ', {_money_plain('cpa')}, ' per conversion')",
            f"concat('- Class ', {_FULL_TIER}, ', budget: ', CASE WHEN roas >= 3.0 THEN 'more' "
            "WHEN roas >= 2.0 THEN 'same' WHEN roas >= 1.5 THEN 'observe' ELSE 'less' END)",
        ], "rank * 3 - 3"),
        _lines(4, "flat_summary JOIN short_extremes USING (campaign_id)", [
            "'## Flags'",
            "CASE WHEN best_spend > 5000 AND best_roas > 2.5 THEN concat('- Saturation: ', best_channel) "
            "ELSE '- Saturation: none' END",
            "CASE WHEN best_spend > historical_spend * 0.4::DOUBLE THEN "
            "concat('- Concentration: ', best_channel) ELSE '- Concentration: none' END",
        ]),
        _lines(5, "short_extremes", [
            "'## Largest gap in return'",
            f"concat('- Highest: ', best_channel, ', ', {_x('best_roas')})",
            f"concat('- Lowest: ', worst_channel, ', ', {_x('worst_roas')})",
            f"concat('- Gap: ', {_x('(best_roas - worst_roas)')})",
            "'Curves flatten: the gap holds for small amounts.'",
        ]),
    ]
)


_NARRATIVE_BASIC = (
    _NARRATIVE.replace(_FULL_TIER, _BASIC_TIER)
    .replace("CASE WHEN roas >= 3.0 THEN 'more' WHEN roas >= 2.0 THEN 'same' "
             "WHEN roas >= 1.5 THEN 'observe' ELSE 'less' END",
             "CASE WHEN roas >= 2.5 THEN 'more' WHEN roas >= 1.5 THEN 'same' ELSE 'less' END")
    .replace("best_spend > 5000 AND best_roas > 2.5", "best_spend > 5000")
)


def _per_scenario(section: int, source: str, texts: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT campaign_id, scenario_id, {section}::BIGINT AS section, {i}::BIGINT AS line, "
        f"{text} AS text FROM {source}" for i, text in enumerate(texts)
    )


_VERDICTS = f"""(SELECT *, {_growth('"TotalROAS"', "projected_roas")} AS uplift
  FROM outcome_totals JOIN flat_summary USING (campaign_id))"""

_NARRATIVE_SCENARIOS = (
    f"SELECT campaign_id, '' AS scenario_id, section, line, text FROM ({_NARRATIVE}) UNION ALL "
    + _per_scenario(6, _VERDICTS, [
        "concat('## Budgets ', scenario_id)",
        f"""concat('- ', {_money('"TotalRevenue"')}, ' from ', {_money('"TotalSpend"')}, ': ',
  {_x('"TotalROAS"')}, ', ', {_pct('uplift')}, ' on the forecast')""",
        "CASE WHEN uplift > 0 THEN 'Above the forecast: yes' ELSE 'Above the forecast: no' END",
    ])
)


def _period(prefix: str) -> str:
    return (f"'spend ', {_money(prefix + '_spend')}, ', revenue ', {_money(prefix + '_revenue')}, "
            f"', ROAS ', {_x(prefix + '_roas')}")


_PROMPT = " UNION ALL ".join(
    [
        _lines(1, "flat_summary", [
            "'You advise a marketing team. Judge the campaign below and propose actions.'",
            f"concat('Last 30 days: ', {_period('historical')})",
            f"concat('Next 30 days: ', {_period('projected')})",
            "'Channels:'",
        ]),
        _lines(2, "short_ranked", [
            f"concat('- ', \"Channel\", ': spend ', {_money('spend')}, ', revenue ', "
            f"{_money('revenue')}, ', ROAS ', {_x('roas')}, ', CPA ', {_money_plain('cpa')}, "
            f"', CPC ', {_money_plain('cpc')})",
        ], "rank"),
        _lines(4, "flat_summary", [
            "'Answer in markdown with four sections: outlook, channels, risks, plan. "
            "Give amounts and percentages.'",
        ]),
    ]
)

_PROMPT_SCENARIOS = (
    f"SELECT campaign_id, '' AS scenario_id, section, line, text FROM ({_PROMPT}) UNION ALL "
    + _per_scenario(3, "outcome_totals", [
        f"""concat('Scenario ', scenario_id, ': spend ', {_money('"TotalSpend"')}, ', revenue ',
  {_money('"TotalRevenue"')}, ', ROAS ', {_x('"TotalROAS"')})""",
    ])
)

_WAYS = {"yyyy-M-d": "%Y-%m-%d", "yyyy-M-d H:m:s": "%Y-%m-%d %H:%M:%S", "M/d/yyyy": "%m/%d/%Y",
         "d/M/yyyy": "%d/%m/%Y", "yyyy/M/d": "%Y/%m/%d"}

_WAY_COUNTS = " UNION ALL ".join(
    f"SELECT campaign_id, {i} AS preference, '{name}' AS name, "
    f"count(try_strptime(raw, '{way}')) AS n FROM dated GROUP BY 1"
    for i, (name, way) in enumerate(_WAYS.items())
)

_BLOCKS = f"""CASE WHEN starts_with(line_text, '## ') THEN 'heading'
    WHEN starts_with(line_text, '### ') THEN 'subheading'
    WHEN starts_with(line_text, '- ') OR starts_with(line_text, '* ') THEN 'bullet'
    ELSE 'paragraph' END AS kind,
  CASE WHEN starts_with(line_text, '## ') THEN {_strip("replace(line_text, '## ', '')")}
    WHEN starts_with(line_text, '### ') THEN {_strip("replace(line_text, '### ', '')")}
    WHEN starts_with(line_text, '- ') OR starts_with(line_text, '* ')
      THEN {_bold(_strip("substr(line_text, 3)"))}
    ELSE {_bold("line_text")} END AS block_text"""

_FORECAST_SELECT = f"""campaign_id, "Date", "Channel", {_rs("Spend Impressions Clicks Conversions "
  "Revenue ROAS Revenue_Lower Revenue_Upper Conversions_Lower Conversions_Upper")}, "IsForecast" """

_SYNTH_NOISE = "md5(concat_ws('|', '42', s_name, channel, strftime(d, '%Y%m%d')))"


def _u(draw: int) -> str:
    return f"(CAST(concat('0x', substr(noise, {1 + 6 * draw}, 6)) AS BIGINT)::DOUBLE / 16777216)"


def _about(middle: float, width: float, draw: int) -> str:
    return f"({middle - width / 2!r}::DOUBLE + {_u(draw)} * {width!r}::DOUBLE)"


def _tenth(x: str) -> str:
    return f"floor(round({x}, 6) * 10.0::DOUBLE + 0.5::DOUBLE) / 10.0::DOUBLE"


def _whole(x: str) -> str:
    return f"floor(round({x}, 6) + 0.5::DOUBLE)"


_SYNTH = f"""WITH cells AS (SELECT s_name, CAST(CAST(d AS DATE) AS DATE) AS d, channel, base, rate, price, val
  FROM supplier, range(TIMESTAMP '2024-02-01', TIMESTAMP '2024-04-01', INTERVAL 1 DAY) AS days(d),
  (VALUES ('Google Ads', 150.0::DOUBLE, 0.04::DOUBLE, 1.5::DOUBLE, 120.0::DOUBLE),
    ('Meta Ads', 200.0::DOUBLE, 0.035::DOUBLE, 1.2::DOUBLE, 90.0::DOUBLE),
    ('LinkedIn Ads', 80.0::DOUBLE, 0.02::DOUBLE, 4.5::DOUBLE, 350.0::DOUBLE),
    ('TikTok Ads', 120.0::DOUBLE, 0.025::DOUBLE, 0.8::DOUBLE, 45.0::DOUBLE))
    AS ch(channel, base, rate, price, val)),
noisy AS (SELECT *, {_SYNTH_NOISE} AS noise FROM cells),
a AS (SELECT *, {_tenth("(" + _tenth("base * " + _about(1.0, 0.3, 0)) + ") * CASE WHEN isodow(d) >= 6 THEN 0.7::DOUBLE ELSE 1.0::DOUBLE END")} AS spend FROM noisy),
b AS (SELECT *, {_whole("spend / price * " + _about(1.0, 0.2, 1))} AS clicks FROM a),
c AS (SELECT *, clicks * {_whole(_about(25.0, 20.0, 2))} AS impressions,
  {_tenth("clicks * rate * " + _about(1.0, 0.4, 3))} AS conversions FROM b)
SELECT s_name AS campaign_id, d AS "Date", channel AS "Channel", {_r("spend", "Spend")},
  {_r("impressions", "Impressions")}, {_r("clicks", "Clicks")}, {_r("conversions", "Conversions")},
  {_r(_tenth("conversions * val * " + _about(1.0, 0.2, 4)), "Revenue")} FROM c"""


def _band(c: str, scale: str, offset: str, z: str) -> tuple[str, str]:
    values = f"list_transform(embedding, lambda x: x::DOUBLE * {scale}::DOUBLE + {offset}::DOUBLE)"
    return f"list_avg({values})", f"{z}::DOUBLE * list_stddev_pop({values})"


def _prediction_bounds(z: str) -> str:
    scales = dict(zip(_MEASURES.split(), (("100.0", "1.0"), ("50.0", "0.0"), ("10.0", "0.5"),
                                          ("5.0", "0.25"), ("200.0", "2.0"))))
    inner = []
    for c, (scale, offset) in scales.items():
        mean, width = _band(c, scale, offset, z)
        inner += [f"{mean} AS mean_{c}", f"{width} AS width_{c}"]
    outer = [_r(f"greatest(mean_{c}, 0.0::DOUBLE)", c) for c in scales]
    for c in ("Revenue", "Conversions"):
        outer.append(_r(f"greatest(mean_{c} - width_{c}, 0.0::DOUBLE)", f"{c}_Lower"))
        outer.append(_r(f"greatest(mean_{c} + width_{c}, 0.0::DOUBLE)", f"{c}_Upper"))
    roas = "CASE WHEN mean_Spend > 0 THEN greatest(mean_Revenue, 0.0::DOUBLE) / mean_Spend ELSE 0.0::DOUBLE END"
    return f"""SELECT campaign_id, "Channel", "Date", {", ".join(outer)}, {_r(roas, "ROAS")},
  true AS "IsForecast"
FROM (SELECT concat('l_', label) AS campaign_id, concat('v_', vec_id) AS "Channel",
  DATE '2024-02-01' AS "Date", {", ".join(inner)} FROM embeddings)"""


def _audit() -> str:
    parts = [
        "SELECT 'loaded' AS step, '' AS \"column\", count(*) AS n_rows FROM tokens",
        "SELECT 'bad_date', 'Date', count(*) FROM tokens WHERE \"Date\" IS NULL",
        "SELECT 'duplicate', '', count(*) - count(DISTINCT (\"Date\", \"Channel\")) FROM tokens "
        'WHERE "Date" IS NOT NULL',
        "SELECT 'final', '', count(*) FROM merged",
    ]
    for c in _MEASURES.split():
        x = c.lower()
        bare = f"TRY_CAST(regexp_replace({x}, '[^0-9.]', '', 'g') AS DOUBLE)"
        parts.append(
            f"SELECT 'null', '{c}', count(*) FROM tokens WHERE \"Date\" IS NOT NULL AND "
            f"CASE WHEN {_is_text(x)} THEN {bare} ELSE TRY_CAST({x} AS DOUBLE) END IS NULL"
        )
        parts.append(
            f"SELECT 'negative', '{c}', count(*) FROM tokens WHERE \"Date\" IS NOT NULL AND "
            f"NOT {_is_text(x)} AND TRY_CAST({x} AS DOUBLE) < 0"
        )
    return f"SELECT 'dirty' AS campaign_id, * FROM ({' UNION ALL '.join(parts)})"


_OUTCOME_RATIOS = f"""{_r(_ratio('"Revenue"', '"Spend"'), "ROAS", 4)},
  {_r(_ratio('"Spend"', '"Conversions"'), "CPA", 4)}, {_r(_ratio('"Spend"', '"Clicks"'), "CPC", 4)},
  {_r(_ratio('"Clicks"', '"Impressions"'), "CTR", 4)}"""

_CURVE_COLUMNS = "alpha_rev alpha_conv alpha_clicks alpha_imp avg_spend avg_revenue avg_conversions"

_CTES["way_counts"] = _WAY_COUNTS

_FINAL = {
    "kpi_ratios": f"""SELECT campaign_id, "Date", "Channel",
  {_rs(_MEASURES + " CTR CPC CPA ROAS ConvRate")} FROM channel_kpis""",
    "calendar_features": """SELECT campaign_id, "Channel", "Date", month("Date")::BIGINT AS "Month",
  quarter("Date")::BIGINT AS "Quarter", CASE WHEN strftime("Date", '%m-%d') IN
    ('07-04','11-25','11-29','12-25') THEN 1 ELSE 0 END::BIGINT AS "HolidayFlag",
  (date_diff('day', DATE '1970-01-01', "Date") + 719163)::BIGINT AS "Ordinal",
  (isodow("Date") - 1)::BIGINT AS "DayOfWeek", day("Date")::BIGINT AS "DayOfMonth"
FROM segment_facts""",
    "rolling_lag": f"""SELECT campaign_id, "Channel", "Date",
  {_rs("Spend_MA7 ROAS_MA7 Spend_Lag7 Revenue_Lag7")} FROM user_featured""",
    "featured_long_history": f"""SELECT campaign_id, "Date", "Channel", "Month", "Quarter",
  "HolidayFlag", {_rs(_MEASURES + " CTR CPC CPA ROAS ConvRate Spend_MA7 ROAS_MA7 Spend_Lag7 "
                      "Revenue_Lag7")} FROM segment_featured""",
    "dataset_summary": f"""SELECT campaign_id, {_r('sum("Spend")', "total_spend")},
  {_r('sum("Revenue")', "total_revenue")}, {_r('sum("Conversions")', "total_conversions")},
  {_r(_ratio('sum("Revenue")', 'sum("Spend")'), "overall_roas")},
  count(DISTINCT "Channel") AS channels_count FROM channel_facts GROUP BY 1""",
    "channel_list": """SELECT campaign_id, "Channel", min("Date") AS first_date
FROM user_facts GROUP BY 1, 2""",
    "daily_totals": f"""SELECT campaign_id, "Date", right("Channel", 1) AS "Channel",
  {", ".join(_r(f'sum("{c}")', c) for c in _MEASURES.split())} FROM user_facts GROUP BY 1, 2, 3""",
    "preview_rows": f"""SELECT campaign_id, strftime("Date", '%Y-%m-%d') AS "Date", "Channel",
  {_rs(_MEASURES)} FROM (SELECT *, row_number() OVER (PARTITION BY campaign_id
    ORDER BY "Date", "Channel") AS n FROM channel_facts) WHERE n <= 15""",
    "iso_records": f"""SELECT campaign_id, strftime("Date", '%Y-%m-%d') AS "Date", "Channel",
  {_rs(_MEASURES)} FROM channel_facts""",
    "clean_dates": """SELECT event_id, "Date" FROM tokens WHERE "Date" IS NOT NULL""",
    "clean_channel": """SELECT event_id, "Channel" FROM tokens""",
    "clean_numeric": f"""SELECT event_id, {_rs(_MEASURES)} FROM clean_rows""",
    "clean_numeric_strict": f"""SELECT event_id,
  {", ".join(_r(_signed(c.lower()), c) for c in _MEASURES.split())} FROM tokens""",
    "duplicate_count": """SELECT 'dirty' AS campaign_id,
  (count(*) - count(DISTINCT ("Date", "Channel")))::BIGINT AS duplicates
FROM tokens WHERE "Date" IS NOT NULL""",
    "merge_duplicates": f"""SELECT campaign_id, "Date", "Channel", {_rs(_MEASURES)} FROM merged""",
    "clean_facts": f"""SELECT campaign_id, "Date", "Channel", {_rs(_MEASURES)} FROM merged""",
    "clean_stored_profile": f"""SELECT campaign_id, "Date", "Channel", {_rs(_MEASURES)}
FROM merged""",
    "cleaning_audit": _audit(),
    "last_row": f"""SELECT campaign_id, "Channel", "Date", {_rs(_MEASURES + " ROAS")}
FROM (SELECT *, row_number() OVER (PARTITION BY campaign_id, "Channel" ORDER BY "Date" DESC) AS n
  FROM user_kpis) WHERE n = 1""",
    "last30_dates": f"""SELECT campaign_id, "Date", "Channel", {_rs(_MEASURES)} FROM segment_dates
WHERE back <= 30""",
    "future_calendar": """SELECT campaign_id, "Channel", "Date" FROM flat_rows""",
    "forecast_flat": f"""SELECT {_FORECAST_SELECT} FROM flat_rows WHERE n < 5""",
    "forecast_skeleton": """SELECT campaign_id, "Channel", "Date", "IsForecast" FROM flat_forecast""",
    "prediction_bounds": _prediction_bounds("1.645"),
    "history_rows": f"""SELECT {_FORECAST_SELECT} FROM old_rows""",
    "projected_summary": f"""SELECT campaign_id, {_rs("projected_spend projected_revenue "
  "projected_conversions projected_roas")} FROM flat_summary""",
    "historical_summary": f"""SELECT campaign_id, {_r('sum("Spend")', "historical_spend")},
  {_r('sum("Revenue")', "historical_revenue")}, {_r('sum("Conversions")', "historical_conversions")},
  {_r(_ratio('sum("Revenue")', 'sum("Spend")'), "historical_roas")}
FROM segment_dates WHERE back <= 30 GROUP BY 1""",
    "forecast_summary": f"""SELECT campaign_id, {_rs("historical_spend historical_revenue "
  "historical_conversions historical_roas projected_spend projected_revenue projected_conversions "
  "projected_roas")} FROM flat_summary""",
    "kpi_cards": f"""SELECT campaign_id, {_rs("projected_revenue projected_roas projected_spend "
  "historical_spend")}, {_r("revenue_growth", "revenue_growth_pct")},
  {_r("projected_roas - historical_roas", "roas_delta")},
  {_r("projected_revenue - projected_spend", "projected_profit")},
  {_r("historical_revenue - historical_spend", "historical_profit")} FROM flat_trend""",
    "daily_actual_vs_forecast": """SELECT campaign_id, "Date", ahead AS is_forecast,
  CASE WHEN NOT ahead THEN floor(round(s_old, 6) + 0.5)::BIGINT END AS spend_actual,
  CASE WHEN ahead THEN floor(round(s_new, 6) + 0.5)::BIGINT END AS spend_forecast,
  CASE WHEN NOT ahead THEN floor(round(r_old, 6) + 0.5)::BIGINT END AS revenue_actual,
  CASE WHEN ahead THEN floor(round(r_new, 6) + 0.5)::BIGINT END AS revenue_forecast,
  CASE WHEN ahead THEN floor(round(lo, 6) + 0.5) ELSE floor(round(r_old, 6) + 0.5) END::BIGINT AS revenue_lower,
  CASE WHEN ahead THEN floor(round(hi, 6) + 0.5) ELSE floor(round(r_old, 6) + 0.5) END::BIGINT AS revenue_upper
FROM (SELECT campaign_id, "Date", bool_and("IsForecast") AS ahead,
  sum("Spend") FILTER (NOT "IsForecast") AS s_old, sum("Spend") FILTER ("IsForecast") AS s_new,
  sum("Revenue") FILTER (NOT "IsForecast") AS r_old, sum("Revenue") FILTER ("IsForecast") AS r_new,
  sum("Revenue_Lower") FILTER ("IsForecast") AS lo, sum("Revenue_Upper") FILTER ("IsForecast") AS hi
  FROM flat_forecast GROUP BY 1, 2)""",
    "channel_summary": f"""SELECT campaign_id, "Channel", {_rs("spend revenue impressions clicks "
  "conversions roas conv_rate cpa cpc")} FROM short_channels""",
    "contribution_share": f"""SELECT campaign_id, "Channel", spend, revenue,
  {_r("CASE WHEN whole > 0 THEN spend::DOUBLE / whole::DOUBLE ELSE 0.0::DOUBLE END", "spend_share")}
FROM (SELECT *, sum(spend) OVER (PARTITION BY campaign_id) AS whole FROM (
  SELECT campaign_id, "Channel", floor(round(spend, 6) + 0.5)::BIGINT AS spend,
    floor(round(revenue, 6) + 0.5)::BIGINT AS revenue FROM short_channels))""",
    "fit_curves": f"""SELECT campaign_id, "Channel", {_rs(_CURVE_COLUMNS)} FROM segment_curves""",
    "fit_curves_many_series": f"""SELECT campaign_id, "Channel", {_rs(_CURVE_COLUMNS)}
FROM user_curves""",
    "simulate": f"""SELECT campaign_id, scenario_id, "Channel", {_rs(_MEASURES, 4)},
  {_OUTCOME_RATIOS} FROM outcome""",
    "scenario_totals": f"""SELECT campaign_id, scenario_id,
  {_rs("TotalSpend TotalRevenue TotalConversions TotalROAS", 4)} FROM outcome_totals""",
    "scenario_totals_direct": f"""SELECT campaign_id, scenario_id,
  {_rs("TotalSpend TotalRevenue TotalConversions TotalROAS", 4)} FROM outcome_totals""",
    "scenario_rollup": f"""SELECT campaign_id, scenario_id, "Channel", is_total,
  {_rs("Spend Conversions Revenue", 4)}, {_r(_ratio('"Revenue"', '"Spend"'), "ROAS", 4)}
FROM (SELECT campaign_id, scenario_id, "Channel", false AS is_total, "Spend", "Conversions",
    "Revenue" FROM outcome
  UNION ALL SELECT campaign_id, scenario_id, 'Total', true, "TotalSpend", "TotalConversions",
    "TotalRevenue" FROM outcome_totals)""",
    "unmatched_budgets": f"""SELECT campaign_id, scenario_id, "Channel", {_r("budget", "budget")}
FROM budgets b WHERE NOT EXISTS (SELECT 1 FROM channel_curves c
  WHERE c.campaign_id = b.campaign_id AND c."Channel" = b."Channel")""",
    "baseline": f"""SELECT campaign_id, "Channel", is_total, {_rs("Spend Conversions Revenue")},
  {_r(_ratio('"Revenue"', '"Spend"'), "ROAS")} FROM channel_base""",
    "scenario_compare": """SELECT o.campaign_id, o.scenario_id, o."Channel",
  floor(round(coalesce(b."Spend", 0), 6) + 0.5)::BIGINT AS base_spend,
  floor(round(o."Spend", 6) + 0.5)::BIGINT AS simulated_spend,
  floor(round(coalesce(b."Revenue", 0), 6) + 0.5)::BIGINT AS base_revenue,
  floor(round(o."Revenue", 6) + 0.5)::BIGINT AS simulated_revenue
FROM outcome o LEFT JOIN channel_base b ON b.campaign_id = o.campaign_id
  AND b."Channel" = o."Channel" AND NOT b.is_total""",
    "optimize": f"""WITH {_split_of("user_curves", "user_budget")}
SELECT campaign_id, "Channel", {_r("total_budget", "total_budget", 4)}, {_r("budget", "budget", 4)}
FROM split""",
    "optimize_scenarios": " UNION ALL ".join(
        f"""SELECT campaign_id, '{name}' AS scenario_id, "Channel", {_r("total_budget", "total_budget", 4)},
  {_r("budget", "budget", 4)}
FROM (WITH {_split_of("channel_curves", f"(SELECT DISTINCT campaign_id, {total}::DOUBLE AS b FROM channel_curves)")}
  SELECT * FROM split)"""
        for name, total in (("low", "100.0"), ("high", "5000.0"))
    ),
    "optimize_many_totals": f"""WITH wanted AS (SELECT concat('c_', p_partkey % 3) AS campaign_id,
  concat('c_', p_partkey % 3, '|', p_partkey) AS pair, p_retailprice * (p_partkey % 50 - 1) AS b FROM part),
wanted_curves AS (SELECT pair AS campaign_id, "Channel", alpha_rev FROM channel_curves JOIN wanted USING (campaign_id)),
wanted_budgets AS (SELECT pair AS campaign_id, b FROM wanted), {_split_of("wanted_curves", "wanted_budgets")}
SELECT split_part(campaign_id, '|', 1) AS campaign_id, split_part(campaign_id, '|', 2) AS scenario_id, "Channel",
  {_r("total_budget", "total_budget", 4)}, {_r("budget", "budget", 4)} FROM split""",
    "optimize_simulate": f"""WITH {_split_of("channel_curves", "thousand")},
result AS (SELECT c.campaign_id, c."Channel", total_budget, budget AS "Spend",
  alpha_imp * ln(budget + 1) AS "Impressions", alpha_clicks * ln(budget + 1) AS "Clicks",
  alpha_conv * ln(budget + 1) AS "Conversions", alpha_rev * ln(budget + 1) AS "Revenue"
  FROM split s JOIN channel_curves c ON c.campaign_id = s.campaign_id AND c."Channel" = s."Channel")
SELECT campaign_id, "Channel", {_r("total_budget", "total_budget", 4)}, {_rs(_MEASURES, 4)},
  {_OUTCOME_RATIOS} FROM result""",
    "optimized_scenario": f"""WITH {_split_of("user_curves", "user_budget")},
whole AS (SELECT s.campaign_id, s."Channel", floor(round(budget, 6) + 0.5) AS x, alpha_rev, alpha_conv
  FROM split s JOIN user_curves c ON c.campaign_id = s.campaign_id AND c."Channel" = s."Channel")
SELECT campaign_id, 'optimized' AS scenario_id, "Channel", {_r("x", "Spend", 4)},
  {_r("alpha_rev * ln(x + 1)", "Revenue", 4)}, {_r("alpha_conv * ln(x + 1)", "Conversions", 4)}
FROM whole""",
    "default_budgets": """SELECT campaign_id, "Channel", is_total,
  floor(round("Spend", 6) + 0.5)::BIGINT AS budget FROM channel_base""",
    "budget_grid": f"""SELECT campaign_id, "Channel", budget,
  {_r("alpha_rev * ln(budget + 1)", "Revenue", 4)},
  {_r("alpha_conv * ln(budget + 1)", "Conversions", 4)}
FROM (SELECT *, unnest(range(0, greatest(5000, 3 * floor(round(CASE WHEN avg_spend > 0 THEN avg_spend
  ELSE 100 END, 6) + 0.5))::BIGINT + 1, 10)) AS budget FROM channel_curves)""",
    "channel_rank": f"""SELECT campaign_id, "Channel", {_r("roas", "roas")}, rank,
  rank = 1 AS is_best, rank = n AND n > 1 AS is_worst FROM user_ranked""",
    "best_channel": f"""SELECT campaign_id,
  CASE WHEN roas > 0 THEN "Channel" ELSE 'Google Ads' END AS best_channel,
  {_r("roas", "best_roas")} FROM user_ranked WHERE rank = 1""",
    "channel_tiers": f"""SELECT campaign_id, "Channel", {_r("roas", "roas")}, {_FULL_TIER} AS tier,
  CASE WHEN roas >= 3.0 THEN 'scale' WHEN roas >= 2.0 THEN 'maintain' WHEN roas >= 1.5
    THEN 'monitor' ELSE 'reduce' END AS action FROM user_channels""",
    "channel_tiers_basic": f"""SELECT campaign_id, "Channel", {_r("roas", "roas")},
  CASE WHEN roas >= 2.5 THEN 'Highly Efficient' WHEN roas >= 1.5 THEN 'Moderately Efficient'
    ELSE 'Underperforming' END AS tier,
  CASE WHEN roas >= 2.5 THEN 'scale' WHEN roas >= 1.5 THEN 'maintain' ELSE 'cap' END AS action
FROM user_channels""",
    "trend_growth": f"""SELECT campaign_id, trend, {_r("revenue_growth", "revenue_growth_pct")},
  {_r("spend_growth", "spend_growth_pct")}, is_healthy, CASE WHEN revenue_growth > 10
    THEN 'steady growth' ELSE 'marginal returns' END AS growth_label FROM flat_trend""",
    "risk_flags": f"""SELECT campaign_id, best_channel, {_r("best_roas", "best_roas")},
  {_r("best_spend", "best_spend")}, best_spend > 5000 AND best_roas > 2.5 AS is_saturating,
  best_spend > historical_spend * 0.4::DOUBLE AS is_concentrated
FROM flat_summary JOIN short_extremes USING (campaign_id)""",
    "shift_plan": f"""SELECT campaign_id, worst_channel AS from_channel,
  {_r("worst_roas", "from_roas")}, best_channel AS to_channel, {_r("best_roas", "to_roas")}
FROM short_extremes""",
    "scenario_verdict": f"""SELECT campaign_id, scenario_id,
  {_rs("TotalSpend TotalRevenue TotalROAS projected_roas", 4)}, {_r("uplift", "uplift_pct", 4)},
  uplift > 0 AS improves
FROM (SELECT *, {_growth('"TotalROAS"', "projected_roas")} AS uplift
  FROM outcome_totals JOIN flat_summary USING (campaign_id))""",
    "narrative": _NARRATIVE,
    "narrative_blocks": f"""SELECT campaign_id, section, kind, count(*) AS blocks
FROM (SELECT campaign_id, section, {_BLOCKS} FROM (
  SELECT campaign_id, section, text AS line_text FROM ({_NARRATIVE})) WHERE line_text <> '')
GROUP BY 1, 2, 3""",
    "prompt_table": _PROMPT,
    "intent_routing": "SELECT message_id, intent FROM routed",
    "answer_messages": f"""SELECT campaign_id, message_id, intent, CASE intent
  WHEN 'allocation' THEN concat('Of ', n, ' channels ', best, ' returns most.')
  WHEN 'forecast' THEN concat('Expected in 30 days: ', {_money("projected_revenue")}, ' revenue, ',
    {_x("projected_roas")}, ' return.')
  WHEN 'return' THEN concat('Measured return: ', {_x("historical_roas")}, '; highest: ', best, '.')
  ELSE 'Topics: allocation, forecast, return.' END AS answer
FROM (SELECT r.*, f.*, e.n, concat(CASE WHEN e.roas > 0 THEN e."Channel" ELSE 'Google Ads' END,
    ' at ', {_x("e.roas")}) AS best
  FROM routed r JOIN (SELECT campaign_id AS c_id, * EXCLUDE (campaign_id) FROM flat_summary) f
    ON f.c_id = r.campaign_id
  JOIN (SELECT campaign_id AS e_id, "Channel", roas, n FROM short_ranked WHERE rank = 1) e
    ON e.e_id = r.campaign_id)""",
    "report_blocks": f"""WITH marked AS (SELECT doc_id, i::BIGINT AS line, concat(
    CASE (i + doc_id) % 5 WHEN 0 THEN '## ' WHEN 1 THEN '  ### ' WHEN 2 THEN '- **'
      WHEN 3 THEN '* ' ELSE '' END,
    replace(x, ' ', CASE WHEN (i + doc_id) % 3 = 0 THEN ' ** ' ELSE ' ' END)) AS raw
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x,
    generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents)),
stripped AS (SELECT doc_id, line, {_strip("raw")} AS line_text FROM marked)
SELECT doc_id, line, {_BLOCKS} FROM stripped WHERE line_text <> ''""",
    "report_kpis": f"""SELECT campaign_id, {_money("historical_revenue")} AS historical_revenue,
  {_money("projected_revenue")} AS projected_revenue, {_x("historical_roas")} AS historical_roas,
  {_x("projected_roas")} AS projected_roas FROM flat_summary""",
    "report_channels": f"""SELECT campaign_id, "Channel", {_money("spend")} AS spend,
  format('{{:,.0f}}', impressions) AS impressions, format('{{:,.0f}}', clicks) AS clicks,
  format('{{:,.1f}}', conversions) AS conversions, {_money("revenue")} AS revenue,
  {_x("roas")} AS roas FROM short_channels""",
    "catalog_latest": f"""SELECT campaign_id, updated_at, filename, storage_path,
  {_r("total_spend", "total_spend")}
FROM (SELECT concat('k_', o_custkey) AS campaign_id, CAST(o_orderdate AS DATE) AS updated_at,
  CAST(o_orderkey AS VARCHAR) AS filename, o_orderpriority AS storage_path,
  o_totalprice AS total_spend, row_number() OVER (PARTITION BY o_custkey ORDER BY
    CAST(o_orderdate AS DATE) DESC, CAST(o_orderkey AS VARCHAR) DESC) AS n FROM orders) WHERE n = 1""",
    "synth_campaigns": _SYNTH,
    "forecast_forest": f"""WITH {forest_stats("short_last")}, {forest_forecast("1.96")}
SELECT campaign_id, "Channel", "Date", "IsForecast", {_FORECAST_NUMBERS} FROM f_rows""",
    "forecast_forest_nodes": f"""WITH {forest_stats("short_last")}, {forest_forecast("1.96")}
SELECT campaign_id, "Channel", "Date", "IsForecast", {_FORECAST_NUMBERS} FROM f_rows""",
    "forecast_all": f"""WITH {forest_stats("short_last")}, {forest_forecast("1.645")}
SELECT campaign_id, "Channel", "Date", "IsForecast", {_FORECAST_NUMBERS}
FROM (SELECT * FROM f_rows UNION ALL BY NAME SELECT * FROM old_rows
  UNION ALL BY NAME SELECT * EXCLUDE (n) FROM flat_rows WHERE n < 5)""",
    "forecast_forest_checks": """SELECT campaign_id, "Channel", 30::BIGINT AS days,
  CAST("Date" + 1 AS DATE) AS first, CAST("Date" + 30 AS DATE) AS last, true AS band_in_order,
  true AS in_range FROM short_last WHERE back = 1 AND n >= 5""",
    "forecast_rows_checks": """SELECT concat('c_', user_id % 3) AS campaign_id,
  concat('ch_', user_id % 5) AS "Channel", 30::BIGINT AS days,
  CAST(max(CAST(ts AS DATE)) + 1 AS DATE) AS first, CAST(max(CAST(ts AS DATE)) + 30 AS DATE) AS last,
  true AS band_in_order, true AS in_range FROM events GROUP BY 1, 2 HAVING count(DISTINCT ts) >= 5""",
    "daily_draws": f"""SELECT f.*, n.n_rows FROM (SELECT campaign_id, "Date", "Channel", {_rs(_MEASURES)}
  FROM channel_facts) f JOIN (SELECT concat('c_', user_id % 3) AS campaign_id, CAST(ts AS DATE) AS "Date",
  concat('ch_', user_id % 5) AS "Channel", count(DISTINCT ts)::DOUBLE AS n_rows FROM events GROUP BY 1, 2, 3) n
  USING (campaign_id, "Date", "Channel")""",
    "prediction_bounds_default": _prediction_bounds("1.96"),
    "prediction_bounds_other": _prediction_bounds("2.576"),
    "narrative_basic": _NARRATIVE_BASIC,
    "narrative_scenarios": _NARRATIVE_SCENARIOS,
    "prompt_scenarios": _PROMPT_SCENARIOS,
    "csv_round_trip": f"""SELECT campaign_id, "Date", "Channel", {_rs(_MEASURES)} FROM merged""",
    "ingest_layouts": f"""SELECT campaign_id, "Date", "Channel", {_rs(_MEASURES)} FROM merged""",
    "ingest_quoted_breaks": f"""SELECT campaign_id, "Date", "Channel", {_rs(_MEASURES)} FROM (
  SELECT 'dirty' AS campaign_id, "Date", concat('Web', chr(10), event_id % 7) AS "Channel",
    {", ".join(f'sum("{c}") AS "{c}"' for c in _MEASURES.split())}
  FROM clean_rows WHERE "Date" IS NOT NULL GROUP BY 1, 2, 3)""",
    "clean_dates_per_file": f"""SELECT campaign_id, "Date", "Channel", {_r('sum(spend)', "Spend")},
  {_r("count(*) FILTER (event_type = 'view')", "Impressions")},
  {_r("count(*) FILTER (event_type = 'click')", "Clicks")},
  {_r("count(*) FILTER (event_type = 'purchase')", "Conversions")}, {_r("count(*)", "Revenue")}
FROM (SELECT d.*, CAST(CASE c.name {" ".join(f"WHEN '{n}' THEN try_strptime(raw, '{w}')"
                                           for n, w in _WAYS.items())} END AS DATE) AS "Date"
  FROM dated d JOIN chosen_way c USING (campaign_id)) WHERE "Date" IS NOT NULL GROUP BY 1, 2, 3""",
    "date_formats": """SELECT campaign_id, 'date_format' AS step, name AS "column", n AS n_rows
FROM chosen_way UNION ALL SELECT w.campaign_id, 'date_tie', w.name, w.n
FROM way_counts w JOIN chosen_way c USING (campaign_id) WHERE w.n = c.n AND w.name <> c.name AND w.n > 0""",
    "dataset_round_trip": f"""SELECT campaign_id, "Date", "Channel", "Month", "Quarter",
  "HolidayFlag"::BIGINT AS "HolidayFlag", {_rs(_MEASURES + " CTR CPC CPA ROAS ConvRate Spend_MA7 "
  "ROAS_MA7 Spend_Lag7 Revenue_Lag7")} FROM channel_featured""",
    "bucketed_dataset": f"""SELECT campaign_id, "Date", "Channel", month("Date")::BIGINT AS "Month", {_rs(_MEASURES)}
FROM (SELECT "Channel" AS campaign_id, "Date", campaign_id AS "Channel", "Impressions", "Clicks",
    "Conversions", "Revenue", CASE WHEN "Channel" LIKE '%3' THEN 0.0 ELSE "Spend" END AS "Spend"
  FROM user_facts WHERE "Channel" NOT LIKE '%7' OR "Channel" LIKE '%17')""",
    "catalog_after_upserts": f"""SELECT campaign_id, 'store' AS storage_path,
  {_r('sum("Spend")', "total_spend")}, {_r('sum("Revenue")', "total_revenue")},
  {_r('sum("Conversions")', "total_conversions")},
  {_r(_ratio('sum("Revenue")', 'sum("Spend")'), "overall_roas")},
  count(DISTINCT "Channel") AS channels_count FROM channel_facts GROUP BY 1""",
    "curves_after_updates": f"""SELECT campaign_id, "Channel", {_rs(_CURVE_COLUMNS)} FROM channel_curves""",
    "kept_dataset": f"""SELECT campaign_id, {_r('sum("Spend")', "total_spend")},
  {_r('sum("Revenue")', "total_revenue")}, {_r('sum("Conversions")', "total_conversions")},
  {_r(_ratio('sum("Revenue")', 'sum("Spend")'), "overall_roas")},
  count(DISTINCT "Channel") AS channels_count, count(DISTINCT "Date") AS days
FROM channel_facts GROUP BY 1""",
    "stream_equals_batch": f"""SELECT campaign_id, "Date", "Channel", "Month", "Quarter",
  "HolidayFlag"::BIGINT AS "HolidayFlag", {_rs(_MEASURES + " CTR CPC CPA ROAS ConvRate Spend_MA7 "
  "ROAS_MA7 Spend_Lag7 Revenue_Lag7")} FROM streamed_featured""",
}


def _closure(sql: str) -> list[str]:
    """Names of the shared parts a text uses, each after the parts it uses itself."""
    found: list[str] = []

    def visit(text: str) -> None:
        for name in _CTES:
            if name not in found and re.search(rf"\b{name}\b", text):
                visit(_CTES[name])
                found.append(name)

    visit(sql)
    return found


def oracle_sql() -> dict[str, str]:
    result = {}
    for name, sql in _FINAL.items():
        parts = [f"{part} AS ({_CTES[part]})" for part in _closure(sql)]
        if parts:
            own = sql.removeprefix("WITH ") if sql.startswith("WITH ") else None
            sql = f"WITH {', '.join(parts)}" + (f", {own}" if own else f" {sql}")
        result[name] = sql
    return result
