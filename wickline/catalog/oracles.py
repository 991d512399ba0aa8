"""The registered queries as DuckDB SQL, stated independently of the Spark plans:
global windows, list folds, pairwise joins and a recursive walk over the trades."""

from __future__ import annotations

import re

from wickline.catalog.rounding import decimals
from wickline.plans.report import MARKS
from wickline.plans.strategy import LONG_REASON, SHORT_REASON


def _ewm(x: str, alpha: str) -> str:
    series = f"list({x}) filter (where {x} is not null) over so_far"
    return f"case when {x} is not null then list_reduce({series}, lambda a, b: (1 - {alpha}) * a + {alpha} * b) end"


def _gapped(alpha: str) -> str:
    """A mean over a series with holes: its weight decays with every row, found or not."""
    moved = f"(a.w * (1 - {alpha}) * a.y + {alpha} * b.y) / (a.w * (1 - {alpha}) + {alpha})"
    step = f"""case when b.y is null then {{'y': a.y, 'w': a.w * (1 - {alpha})}}
                    when a.y is null then {{'y': b.y, 'w': 1::double}}
                    else {{'y': {moved}, 'w': 1::double}} end"""
    return f"list_reduce(list({{'y': x, 'w': 1::double}}) over so_far, lambda a, b: {step}).y"


def _bars(lo: str, hi: str, source: str = "local_ticks") -> str:
    inside = f"cast(local_ts as time) >= time '{lo}' {'and' if lo < hi else 'or'} cast(local_ts as time) < time '{hi}'"
    return f"""
        select symbol, time_bucket(interval 30 minute, local_ts) as local_ts,
               arg_min(price, event_id) as open, max(price) as high, min(price) as low,
               arg_max(price, event_id) as close, cast(count(*) as double) as volume
        from {source} where {inside} group by all"""


def _outcomes(signals: str, hold: int, leverage: float, target: float, mult: float) -> str:
    """Signals with price levels -> candidates, by a self-join on the ordinal."""
    return f"""
        with levels as (
            select *, close * (1 + dir * {target} / {leverage}) as target, close - dir * {mult} * atr as stop
            from (select *, case side when 'long' then 1 else -1 end as dir from {signals})
            where bar_idx < n - {hold} - 1),
        steps as (
            select l.*, p.bar_idx - l.bar_idx as step, p.local_ts as p_ts, p.close as p_close,
                   lag(p.local_ts) over w as b_ts, lag(p.close) over w as b_close,
                   case when cast(p.local_ts as date) <> cast(l.local_ts as date) then 1
                        when case side when 'long' then p.low <= stop else p.high >= stop end then 2
                        when case side when 'long' then p.high >= target else p.low <= target end then 3
                        when p.bar_idx = l.bar_idx + {hold} then 4 end as code
            from levels l join {signals}_bars p
              on p.symbol = l.symbol and p.bar_idx between l.bar_idx + 1 and l.bar_idx + {hold}
            window w as (partition by l.symbol, l.bar_idx order by p.bar_idx)),
        firsts as (select * from steps where code is not null
                   qualify row_number() over (partition by symbol, bar_idx order by step) = 1)
        select symbol, cast(local_ts as date) as session_date, bar_idx as entry_idx,
               bar_idx + step - if(code = 1, 1, 0) as exit_idx,
               local_ts as entry_local, if(code = 1, b_ts, p_ts) as exit_local, side, close as entry_price,
               case code when 1 then b_close when 2 then stop when 3 then target else p_close end as exit_price,
               cast(step - if(code = 1, 1, 0) as integer) as bars_held, code = 3 as hit_target,
               if(ema10 > ema20, 'Uptrend', 'Downtrend') as trend, reason,
               ['day_end_exit', 'atr_stop', 'profit_target', 'time_exit'][code] as exit_reason,
               target as target_price, stop as stop_price
        from firsts where code <> 1 or step > 1"""


def _greedy(candidates: str, leverage: float, target: float, commission: float = 1.0) -> str:
    """Candidates -> trades: follow, over all days of a symbol, from each taken
    candidate to the first one at or after its exit."""
    return f"""
        with recursive following as (
            select c.symbol, c.entry_idx, min(d.entry_idx) as next_idx
            from {candidates} c left join {candidates} d on d.symbol = c.symbol and d.entry_idx >= c.exit_idx
            group by all),
        taken as (
            select symbol, min(entry_idx) as entry_idx from {candidates} group by symbol
            union all
            select f.symbol, f.next_idx from taken t join following f using (symbol, entry_idx)
            where f.next_idx is not null),
        ret as (
            select c.*, if(side = 'long', 1, -1) * (exit_price - entry_price) / entry_price * {leverage} as ret
            from {candidates} c join taken using (symbol, entry_idx))
        select symbol, session_date, entry_idx, exit_idx,
               timezone('UTC', timezone('America/New_York', entry_local)) as entry_time,
               timezone('UTC', timezone('America/New_York', exit_local)) as exit_time,
               entry_local, exit_local, side, entry_price, exit_price, bars_held, hit_target,
               ret as option_return_pct, ret * 1000 - {commission} as pnl_usd, ret / {target} as r_multiple,
               trend, reason, exit_reason, 'synthetic' as pricing_mode, 'synthetic' as option_lookup_status
        from ret"""


def _ranked_pairs(steps: int) -> str:
    """Every qualifying contract of every trade, and the k-th of them."""
    return f"""
        select symbol, entry_time, expiration, strike, ticker from (
            select *, row_number() over (partition by symbol, entry_time
                        order by abs(expiration - wanted), expiration, abs(strike - spot), coalesce(ticker, '')) as rn,
                   count(*) over (partition by symbol, entry_time) as n
            from pairs)
        where rn = least({max(steps - 1, 0)}, n - 1) + 1"""


def _kth(steps: int) -> str:
    return f"""
        select symbol, entry_time, expiration, strike, contract from (
            select e.symbol, e.entry_time, e.expiration, c.strike, c.contract,
                   row_number() over (partition by e.symbol, e.entry_time order by abs(c.strike - spot)) as rn,
                   count(*) over (partition by e.symbol, e.entry_time) as n
            from expiries e join (select underlying, contract_type, expiration, strike, min(contract) as contract
                                  from chain group by all) c
              on c.underlying = e.symbol and c.contract_type = e.contract_type and c.expiration = e.expiration
             and if(e.contract_type = 'call', c.strike >= spot, c.strike <= spot))
        where rn = least({max(steps - 1, 0)}, n - 1) + 1"""


def _prices(picks: str, extra_days: int) -> str:
    legs = []
    for leg in ("entry", "exit"):
        legs.append(
            f"coalesce(arg_min(q.close, q.ts) filter (where q.ts >= t.{leg}_time), "
            f"arg_max(q.close, q.ts) filter (where q.ts <= t.{leg}_time)) as {leg}_quote"
        )
    return f"""
        select t.symbol, t.entry_time, {', '.join(legs)}, count(q.ts) > 0 as quoted
        from trades t join {picks} p using (symbol, entry_time)
        left join quotes q on q.ticker = p.ticker
             and q.session_date between t.session_date and cast(t.exit_local as date) + {extra_days}
        where p.ticker is not null group by t.symbol, t.entry_time"""


def _summary(source: str, by: str) -> str:
    keys, group = (f"{by},", f"group by {by}") if by else ("", "")
    return f"""
        select {keys} count(*) as total, count(*) filter (where hit_target) as wins,
               count(*) filter (where not hit_target) as losses,
               coalesce(sum(pnl_usd), 0) as net_pnl, coalesce(sum(r_multiple), 0) as total_r,
               coalesce(avg(r_multiple), 0) as avg_r,
               coalesce(avg(if(hit_target, 1.0, 0.0)), 0) as win_rate,
               count(*) as setups, 0 as incomplete
        from {source} {group}"""


# Named intermediate results, each over the ones before it.
STEPS: dict[str, str] = {
    "ticks": """
        select event_type as symbol, ts, event_id,
               cast(3000000 + sum(cast(cast(value as decimal(12, 2)) * 100 as bigint) - 5000)
                    over (partition by event_type order by ts, event_id) as double) / 10000 as price
        from events""",
    "local_ticks": "select *, timezone('America/New_York', timezone('UTC', ts)) as local_ts from ticks",
    "bars": _bars("09:30:00", "16:00:00"),
    "moved": """
        select *, lag(close) over w as prev_close, close - lag(close) over w as delta
        from bars window w as (partition by symbol order by local_ts)""",
    "split": """
        select *, greatest(delta, 0) + delta * 0 as gain, greatest(-delta, 0) + delta * 0 as loss,
               greatest(high - low, coalesce(abs(high - prev_close), 0), coalesce(abs(low - prev_close), 0)) as tr
        from moved""",
    "averaged": f"""
        select *, {_ewm('gain', '(1::double / 14)')} as avg_gain, {_ewm('loss', '(1::double / 14)')} as avg_loss,
               {_ewm('tr', '(1::double / 14)')} as atr, {_ewm('close', '(2::double / 11)')} as ema10,
               {_ewm('close', '(2::double / 21)')} as ema20,
               if(count(close) over last20 = 20, avg(close) over last20, null) as bb_basis,
               if(count(close) over last20 = 20, stddev_pop(close) over last20, null) as sigma,
               if(count(volume) over last20 = 20, avg(volume) over last20, null) as volume_sma
        from split
        window so_far as (partition by symbol order by local_ts rows unbounded preceding),
               last20 as (partition by symbol order by local_ts rows 19 preceding)""",
    "measured": """
        select *, bb_basis + 2 * sigma as bb_upper, bb_basis - 2 * sigma as bb_lower,
               volume / nullif(volume_sma, 0) as rel_volume,
               coalesce(100 - 100 / (1 + avg_gain / nullif(avg_loss, 0)), 50) as rsi
        from averaged""",
    "indexed": """
        select *, row_number() over (partition by symbol order by local_ts) - 1 as bar_idx,
               count(*) over (partition by symbol) as n
        from measured where bb_basis is not null and rel_volume is not null""",
    "signals_bars": "select * from indexed",
    "signals": f"""
        select *, if(close < bb_lower, 'long', 'short') as side,
               if(close < bb_lower, '{LONG_REASON}', '{SHORT_REASON}') as reason
        from indexed
        where (close < bb_lower and rsi <= 35) or (close > bb_upper and rsi >= 65)""",
    "candidates": _outcomes("signals", hold=3, leverage=20.0, target=0.05, mult=1.0),
    "trades": _greedy("candidates", leverage=20.0, target=0.05),
    "long_candidates": _outcomes("signals", hold=8, leverage=20.0, target=0.2, mult=2.5),
    "long_trades": _greedy("long_candidates", leverage=20.0, target=0.2),
    "crossing_bars": """
        select * replace (row_number() over (partition by symbol order by local_ts) - 1 as bar_idx),
               count(*) over (partition by symbol) as n
        from (select symbol, local_ts, high, low, close, ema10, ema20, 0 as bar_idx, 0.0 as atr,
                     close > ema20 and not lag(close > ema20) over (partition by symbol order by local_ts) as crossed
              from averaged)
        where crossed is not null""",
    "crossing": "select *, 'long' as side, 'close_crossed_above_slow_average' as reason from crossing_bars where crossed",
    "crossing_candidates": _outcomes("crossing", hold=3, leverage=20.0, target=0.05, mult=1.0),
    "crossing_trades": _greedy("crossing_candidates", leverage=20.0, target=0.05),
    "contracts": """
        select symbol as underlying, contract_type, session_date as as_of, session_date + dte as expiration,
               cast(strike as double) as strike,
               if(strike % 11 = 0, null, 'O:' || symbol || strftime(session_date + dte, '%y%m%d')
                  || if(contract_type = 'call', 'C', 'P') || strike) as ticker
        from (select symbol, cast(local_ts as date) as session_date,
                     cast(floor(arg_min(open, local_ts)) as bigint) as atm from bars group by all),
             (select unnest([0, 1, 3, 7, 14]) as dte), (select unnest(['call', 'put']) as contract_type),
             (select unnest(range(-6, 7)) as off), lateral (select atm + off as strike)""",
    "chain": """
        select underlying, contract_type, expiration, strike, min(ticker) as contract from contracts group by all""",
    "quotes": """
        select c.ticker, cast(b.local_ts as date) as session_date,
               timezone('UTC', timezone('America/New_York', b.local_ts)) as ts,
               round(1 + 0.1 * (c.expiration - c.as_of)
                     + greatest(if(c.contract_type = 'call', b.close - c.strike, c.strike - b.close), 0), 4) as close
        from contracts c join bars b on b.symbol = c.underlying and cast(b.local_ts as date) = c.as_of
        where c.ticker is not null and c.strike % 5 <> 0 and (hour(b.local_ts) + c.strike) % 4 <> 0""",
    "requests": """
        select *, if(side = 'long', 'call', 'put') as contract_type, entry_price as spot, session_date + 2 as wanted
        from trades""",
    "pairs": """
        select r.*, c.expiration, c.strike, c.ticker
        from requests r join contracts c
          on c.underlying = r.symbol and c.contract_type = r.contract_type and c.as_of = r.session_date
         and c.expiration between r.session_date and r.session_date + 14
         and if(r.side = 'long', c.strike >= spot, c.strike <= spot)""",
    "picks": _ranked_pairs(1),
    "picks_2": _ranked_pairs(2),
    "prices": _prices("picks", 1),
    "found": """
        select r.*, p.ticker, q.entry_quote, q.exit_quote,
               case when not exists (select 1 from contracts c where c.underlying = r.symbol
                                     and c.contract_type = r.contract_type and c.as_of = r.session_date
                                     and c.expiration between r.session_date and r.session_date + 14)
                         then 'reference_api_error:reference_empty'
                    when p.symbol is null then 'contract_not_found'
                    when p.ticker is null then 'missing_contract_ticker'
                    when not coalesce(q.quoted, false) then 'no_price_bars:empty'
                    when q.entry_quote is null or q.exit_quote is null then 'missing_entry_or_exit_price'
                    else 'ok' end as status
        from requests r left join picks p using (symbol, entry_time) left join prices q using (symbol, entry_time)""",
    "enriched": """
        select symbol, session_date, entry_idx, entry_time, entry_local, exit_local, side, entry_price, exit_price,
               bars_held, trend, reason, exit_reason, ticker as option_contract, entry_quote as option_entry_price,
               exit_quote as option_exit_price,
               if(status = 'ok', 'polygon_real', 'synthetic') as pricing_mode, status as option_lookup_status,
               if(real is null, option_return_pct, real) as option_return_pct,
               if(real is null, pnl_usd, real * 1000 - 1) as pnl_usd,
               if(real is null, r_multiple, real / 0.05) as r_multiple,
               if(real is null, hit_target, real >= 0.05) as hit_target
        from (select *, if(status = 'ok' and entry_quote > 0, exit_quote / entry_quote - 1, null) as real
              from found)""",
    "expiries": """
        select r.*, e.expiration,
               cast(floor(date_diff('second', r.entry_local, cast(e.expiration as timestamp)) / 86400.0) as integer)
                   as days_to_expiry,
               exists (select 1 from chain c where c.underlying = r.symbol) as listed
        from requests r left join (
            select r.symbol, r.entry_time, min(c.expiration) as expiration
            from requests r join chain c on c.underlying = r.symbol and c.expiration >= r.wanted
            group by all) e using (symbol, entry_time)""",
    "strikes": _kth(1),
    "strikes_99": _kth(99),
    "reachable": """
        select s.symbol, s.entry_time, s.contract as ticker
        from strikes s join expiries e using (symbol, entry_time) where abs(e.days_to_expiry) <= 10""",
    "chain_prices": _prices("reachable", 0),
    "chain_found": """
        select e.*, p.ticker, q.entry_quote, q.exit_quote,
               case when not e.listed then 'no_chain_from_yahoo'
                    when e.expiration is null then 'no_matching_expiry'
                    when abs(e.days_to_expiry) > 10 then 'historical_chain_unavailable'
                    when p.ticker is null then 'contract_not_found'
                    when not coalesce(q.quoted, false) then 'no_price_bars'
                    when q.entry_quote is null or q.exit_quote is null then 'missing_entry_or_exit_price'
                    else 'ok' end as status
        from expiries e left join reachable p using (symbol, entry_time)
        left join chain_prices q using (symbol, entry_time)""",
    "examples": """
        select * from (
            select *, row_number() over (partition by symbol order by priority, entry_time) as example
            from (select *, case when row_number() over w > 1 then 2 when hit_target then 0 else 1 end as priority
                  from trades window w as (partition by symbol, hit_target order by entry_time)))
        where example <= 3""",
}

# The same steps over bars of a minute, in the session and around the clock.
for _suffix, _lo, _hi in (("_1m", "09:30:00", "16:00:00"), ("_day", "00:00:00", "23:59:00")):
    STEPS[f"bars{_suffix}"] = _bars(_lo, _hi).replace("interval 30 minute", "interval 1 minute")
    _again = ["moved", "split", "averaged", "measured", "indexed", "signals_bars", "signals"]
    for _name in _again:
        STEPS[f"{_name}{_suffix}"] = re.sub(rf"\b(bars|{'|'.join(_again)})\b", rf"\1{_suffix}", STEPS[_name])
STEPS["signals_1m_bars"] = "select * from indexed_1m"
STEPS["candidates_390"] = _outcomes("signals_1m", hold=390, leverage=20.0, target=0.2, mult=2.5)

# The look-ups over listings and quotes with which they end in every possible way.
_FRIDAYS = "[session_date + cast(1 + (4 - dayofweek(session_date) + 7) % 7 as integer) + 7 * k for k in [0, 1, 2]]"
STEPS["contracts_odd"] = """
    select symbol as underlying, contract_type, session_date as as_of, expiration, cast(strike as double) as strike,
           if(strike % 11 = 0, null, 'O:' || symbol || strftime(expiration, '%y%m%d')
              || if(contract_type = 'call', 'C', 'P') || strike) as ticker
    from (select symbol, session_date, contract_type, unnest(expiries) as expiration,
                 atm + off + case when day(session_date) % 7 <> 0 then 0 when contract_type = 'call' then -80 else 80 end as strike
          from (select symbol, cast(local_ts as date) as session_date, cast(floor(arg_min(open, local_ts)) as bigint) as atm
                from bars group by all),
               lateral (select if(symbol = 'signup', [last_day(session_date) - 7], FRIDAYS) as expiries),
               (select unnest(['call', 'put']) as contract_type), (select unnest(range(-6, 7)) as off)
          where symbol <> 'error' and day(session_date) % 5 <> 0)""".replace("FRIDAYS", _FRIDAYS)
STEPS["quotes_odd"] = """
    select c.ticker, cast(b.local_ts as date) as session_date,
           timezone('UTC', timezone('America/New_York', b.local_ts)) as ts,
           if(c.strike % 7 = 3, null, round(1 + 0.1 * (c.expiration - cast(b.local_ts as date))
              + greatest(if(c.contract_type = 'call', b.close - c.strike, c.strike - b.close), 0), 4)) as close
    from (select distinct underlying, contract_type, expiration, strike, ticker from contracts_odd) c
    join bars b on b.symbol = c.underlying and cast(b.local_ts as date) between c.expiration - 14 and c.expiration
    where c.ticker is not null and c.strike % 5 <> 0
      and if(c.strike % 3 = 1, hour(b.local_ts) < 11, (hour(b.local_ts) + c.strike) % 4 <> 0)"""
_odd = ["chain", "pairs", "picks", "prices", "found", "enriched", "expiries", "strikes", "reachable", "chain_prices", "chain_found"]
for _name in _odd:
    STEPS[f"{_name}_odd"] = re.sub(rf"\b(contracts|quotes|{'|'.join(_odd)})\b(?! as)", r"\1_odd", STEPS[_name])
STEPS["enriched_chain_odd"] = (
    STEPS["enriched_odd"].replace("polygon_real", "yahoo_real").replace("from found_odd", "from chain_found_odd")
)

STEPS["spans"] = """
    select underlying, contract_type, expiration, strike, min(ticker) as ticker, min(as_of) as listed_from,
           max(as_of) as listed_to from contracts_odd group by all"""
STEPS["pairs_spans"] = """
    select r.*, c.expiration, c.strike, c.ticker
    from requests r join spans c
      on c.underlying = r.symbol and c.contract_type = r.contract_type
     and r.session_date between c.listed_from and c.listed_to
     and c.expiration between r.session_date and r.session_date + 14
     and if(r.side = 'long', c.strike >= spot, c.strike <= spot)"""

STEPS["large_candidates"] = _outcomes("signals", hold=3, leverage=2000.0, target=0.05, mult=1.0)
STEPS["large_trades"] = _greedy("large_candidates", leverage=2000.0, target=0.05).replace("ret * 1000", "ret * 250000")

# Steps that each step reads.
READS: dict[str, list[str]] = {}


def _reads(text: str, earlier: list[str]) -> list[str]:
    words = set(text.replace("(", " ").replace(")", " ").replace(",", " ").split())
    return [name for name in earlier if name in words]


for _position, (_name, _text) in enumerate(STEPS.items()):
    READS[_name] = _reads(_text, list(STEPS)[:_position])

STATUS_COLUMNS = """symbol, entry_time, ticker as option_contract, round(entry_quote, 6) as option_entry_price,
    round(exit_quote, 6) as option_exit_price"""

REPRICED = """symbol, entry_time, round(option_return_pct, 6) as option_return_pct, round(pnl_usd, 6) as pnl_usd,
    round(r_multiple, 6) as r_multiple, hit_target, exit_reason, pricing_mode, option_lookup_status"""


def _two(x: str) -> str:
    return f"printf('%.2f', {x})"


def _log(ids: str, source: str) -> str:
    return f"""
        select symbol, {ids} as trade_id, entry_local as entry_time, exit_local as exit_time, side,
               coalesce(nullif(option_contract, ''), symbol || if(side = 'long', '-SIM-C', '-SIM-P')) as option_contract,
               option_entry_price, option_exit_price, entry_price as underlying_entry_price,
               exit_price as underlying_exit_price, bars_held, reason as signal_reason, exit_reason, hit_target,
               option_return_pct, pnl_usd, r_multiple, trend, pricing_mode, option_lookup_status
        from {source}"""


PER_SYMBOL = "row_number() over (partition by symbol order by entry_time)"

# The queries over those steps. Doubles are rounded at the end.
FINAL: dict[str, str] = {
    "running_price": "select symbol, ts, event_id, price from ticks",
    "bars_30m": """
        select symbol, timezone('UTC', timezone('America/New_York', local_ts)) as ts, local_ts,
               cast(local_ts as date) as session_date, open, high, low, close, volume from bars""",
    "session_wrap": f"""
        select symbol, hour(local_ts) as hour, count(*) as bars, sum(volume) as volume, max(high) as high
        from ({_bars("20:00:00", "08:00:00")}) group by all""",
    "read_bars_range": """
        select symbol, local_ts, open, high, low, close, volume from bars
        where symbol in ('click', 'purchase') and cast(local_ts as date) between '2024-01-05' and '2024-01-19'""",
    "normalized_bars": """
        select symbol, local_ts, open, high, low, close, if(volume % 5 = 0, null, volume) as volume
        from bars where volume % 7 <> 0""",
    "option_bars_ohlc": """
        select session_date, count(*) as quotes, count(distinct ticker) as tickers, sum(close) as total_close
        from quotes where session_date between '2024-01-08' and '2024-01-12' group by 1""",
    "rolling_mean_std": "select symbol, local_ts, bb_basis as rolling_mean, sigma as rolling_std from averaged",
    "bollinger": "select symbol, local_ts, bb_basis, bb_upper, bb_lower from measured",
    "ewm_mean": f"""
        select symbol, local_ts, {_ewm('range', '(1::double / 14)')} as slow, {_ewm('close', '0.3::double')} as fast,
               close as same
        from (select *, high - low as range from bars)
        window so_far as (partition by symbol order by local_ts rows unbounded preceding)""",
    "ema_10_20": "select symbol, local_ts, ema10, ema20 from averaged",
    "gain_loss": "select symbol, local_ts, prev_close, delta, gain, loss from split",
    "rsi": "select symbol, local_ts, rsi from measured",
    "true_range_atr": "select symbol, local_ts, tr, atr from averaged",
    "rel_volume": "select symbol, local_ts, volume_sma, rel_volume from measured",
    "prepared": """
        select symbol, local_ts, open, high, low, close, volume, bb_basis, bb_upper, bb_lower, rsi, atr, volume_sma,
               rel_volume, ema10, ema20, bar_idx, n as bars from indexed""",
    "signals": """
        select symbol, local_ts, bar_idx, close, rsi, side, reason, bar_idx < n - 4 as eligible from signals""",
    "volume_gate": "select symbol, side, count(*) as signals from signals where rel_volume >= 1.2 group by all",
    "forward_path": """
        select s.symbol, s.bar_idx as entry_idx, cast(p.bar_idx - s.bar_idx as integer) as step,
               p.local_ts as step_time, cast(p.local_ts as date) as step_date, p.high as step_high,
               p.low as step_low, p.close as step_close
        from signals s join indexed p on p.symbol = s.symbol and p.bar_idx between s.bar_idx + 1 and s.bar_idx + 3""",
    "candidate_outcomes": "select * from candidates",
    "barrier_trades": "select * from candidates_390",
    "ewm_gaps": f"""
        select symbol, local_ts, {_gapped('(1::double / 14)')} as slow, {_gapped('0.3::double')} as fast,
               last_value(x ignore nulls) over so_far as same
        from (select *, if(volume % 5 in (0, 3), null, close) as x from bars)
        window so_far as (partition by symbol order by local_ts rows unbounded preceding)""",
    "wide_bands": """
        select symbol, local_ts, mean as bb_basis, mean + 2 * std as bb_upper, mean - 2 * std as bb_lower
        from (select symbol, local_ts, if(count(*) over w = 500, avg(close) over w, null) as mean,
                     if(count(*) over w = 500, stddev_pop(close) over w, null) as std
              from bars_day window w as (partition by symbol order by local_ts rows 499 preceding))""",
    "trades": "select * from trades",
    "long_hold_trades": """
        select symbol, entry_idx, exit_idx, side, exit_reason, bars_held, pnl_usd, r_multiple from long_trades""",
    "custom_strategy_trades": """
        select symbol, entry_local, entry_idx, exit_idx, side, exit_reason, pnl_usd, trend from crossing_trades""",
    "summary": _summary("trades", ""),
    "summary_by_symbol": _summary("trades", "symbol, side"),
    "summary_by_trend": f"""
        select trend_order, trend, coalesce(total, 0) as total, coalesce(wins, 0) as wins,
               coalesce(losses, 0) as losses, coalesce(net_pnl, 0) as net_pnl, coalesce(total_r, 0) as total_r,
               coalesce(avg_r, 0) as avg_r, coalesce(win_rate, 0) as win_rate
        from (values (0, 'Uptrend'), (1, 'Downtrend')) named(trend_order, trend)
        left join ({_summary("trades", "trend")}) using (trend)""",
    "contracts_candidates": """
        select symbol, entry_time, expiration, count(*) as qualifying from pairs group by all""",
    "contracts_by_interval": _ranked_pairs(1).replace("from pairs", "from pairs_spans"),
    "contract_rank_k": "select * from picks",
    "contract_rank_spill": _ranked_pairs(9),
    "contract_rank_clamp": _ranked_pairs(99),
    "nearest_expiry": """
        select symbol, entry_time, wanted, expiration, days_to_expiry, abs(days_to_expiry) <= 10 as within_reach
        from expiries""",
    "kth_otm_strike": "select * from strikes",
    "kth_otm_strike_clamp": "select * from strikes_99",
    "asof_price": _prices("picks_2", 1),
    "lookup_status_agg": f"""
        select {STATUS_COLUMNS}, if(status = 'ok', 'polygon_real', 'synthetic') as pricing_mode,
               status as option_lookup_status from found""",
    "lookup_status_chain": f"""
        select {STATUS_COLUMNS}, if(status = 'ok', 'yahoo_real', 'synthetic') as pricing_mode,
               status as option_lookup_status from chain_found""",
    "lookup_branches_agg": f"""
        select {STATUS_COLUMNS}, if(status = 'ok', 'polygon_real', 'synthetic') as pricing_mode,
               status as option_lookup_status from found_odd""",
    "lookup_branches_chain": f"""
        select {STATUS_COLUMNS}, if(status = 'ok', 'yahoo_real', 'synthetic') as pricing_mode,
               status as option_lookup_status from chain_found_odd""",
    "nearest_expiry_varied": """
        select symbol, entry_time, wanted, expiration, days_to_expiry, abs(days_to_expiry) <= 10 as within_reach
        from expiries_odd""",
    "repriced_chain": f"select {REPRICED} from enriched_chain_odd",
    "volume_gate_level": """
        select symbol, side, count(*) as signals from signals where rel_volume >= 0.8 and volume_sma >= 1.4 group by all""",
    "eligible_signals": "select symbol, local_ts, bar_idx, bar_idx < n - 391 as eligible from signals_1m",
    "repriced_trades": f"select {REPRICED} from enriched",
    "real_only": f"select {REPRICED} from enriched where option_lookup_status = 'ok'",
    "enriched_summary": _summary("enriched", "trend, pricing_mode"),
    "unimplemented_provider": """
        select 'synthetic' as pricing_mode, status as option_lookup_status, count(*) as trades
        from trades, (select unnest(['provider_not_implemented', 'unknown_provider:other', 'synthetic']) as status)
        group by all""",
    "trade_log": _log(PER_SYMBOL, "enriched"),
    "trade_log_overall": """
        select row_number() over (order by entry_time, symbol) as trade_id, symbol, entry_local as entry_time,
               symbol || if(side = 'long', '-SIM-C', '-SIM-P') as option_contract, reason as signal_reason,
               exit_price as underlying_exit_price from trades""",
    "display_log": f"""
        select symbol, {PER_SYMBOL} as number, strftime(entry_local, '%Y-%m-%d %H:%M') as entry_time,
               strftime(exit_local, '%Y-%m-%d %H:%M') as exit_time, side, {_two('entry_price')} as spot_in,
               {_two('exit_price')} as spot_out, coalesce(nullif(option_contract, ''), '-') as option,
               coalesce({_two('option_entry_price')}, '-') as option_in,
               coalesce({_two('option_exit_price')}, '-') as option_out, pricing_mode as mode,
               option_lookup_status as lookup_status, exit_reason,
               {_two('option_return_pct * 100')} || '%' as option_return, {_two('pnl_usd')} as pnl,
               {_two('r_multiple')} as r
        from enriched""",
    "example_trades": "select symbol, example, entry_local, hit_target, side, pnl_usd from examples",
    "trade_context": """
        select e.symbol, e.example, i.bar_idx - greatest(e.entry_idx - 20, 0) as position, i.local_ts, i.close,
               i.bb_upper, i.bb_basis, i.bb_lower, i.rsi, i.bar_idx = e.entry_idx as is_entry,
               i.bar_idx = e.exit_idx as is_exit
        from examples e join indexed i
          on i.symbol = e.symbol and i.bar_idx between e.entry_idx - 20 and e.exit_idx + 20
        where e.example <= 2""",
    "trade_context_marks": """
        select e.symbol, e.example, i.bar_idx - greatest(e.entry_idx - 5, 0) as position, i.local_ts, i.close,
               i.bar_idx = e.entry_idx as is_entry, i.bar_idx = e.exit_idx as is_exit,
               MARKS
        from examples e join indexed i
          on i.symbol = e.symbol and i.bar_idx between e.entry_idx - 5 and e.exit_idx + 5
        where e.example <= 2""".replace("MARKS", ", ".join(f"e.{c}" for c in MARKS)),
    "summary_text": f"""
        select symbol, cast(total as varchar) as setups, cast(total as varchar) as total, cast(wins as varchar) as wins,
               cast(losses as varchar) as losses, '0' as incomplete, '$' || format('{{:,.2f}}', net_pnl) as net_pnl,
               format('{{:,.2f}}', total_r) as total_r, printf('%.2f', avg_r) as avg_r,
               printf('%.2f', win_rate * 100) || '%' as win_rate
        from ({_summary("large_trades", "symbol")})""",
}


def _needed(text: str) -> list[str]:
    wanted: set[str] = set()
    queue = _reads(text, list(STEPS))
    while queue:
        name = queue.pop()
        if name not in wanted:
            wanted.add(name)
            queue.extend(READS[name])
    return [name for name in STEPS if name in wanted]


def statement(name: str) -> str:
    """One self-contained statement; doubles rounded as in the Spark queries."""
    steps = [f"{step} as materialized ({STEPS[step]})" for step in _needed(FINAL[name])]
    body = f"select columns(*) from ({FINAL[name]})"
    rounded = DOUBLES.get(name, [])
    if rounded:
        items = ", ".join(f"round({c}, {decimals(c)}) + 0.0 as {c}" for c in rounded)
        body = f"select * replace ({items}) from ({FINAL[name]})"
    return f"with {', '.join(steps)} {body}"


_TRADE_DOUBLES = ["entry_price", "exit_price", "option_return_pct", "pnl_usd", "r_multiple"]
_SUMMARY_DOUBLES = ["net_pnl", "total_r", "avg_r", "win_rate"]
_INDICATORS = ["bb_basis", "bb_upper", "bb_lower", "rsi", "atr", "volume_sma", "rel_volume", "ema10", "ema20"]
DOUBLES: dict[str, list[str]] = {
    "running_price": ["price"],
    "bars_30m": ["open", "high", "low", "close", "volume"],
    "session_wrap": ["volume", "high"],
    "read_bars_range": ["open", "high", "low", "close", "volume"],
    "normalized_bars": ["open", "high", "low", "close", "volume"],
    "option_bars_ohlc": ["total_close"],
    "rolling_mean_std": ["rolling_mean", "rolling_std"],
    "bollinger": ["bb_basis", "bb_upper", "bb_lower"],
    "ewm_mean": ["slow", "fast", "same"],
    "ewm_gaps": ["slow", "fast", "same"],
    "wide_bands": ["bb_basis", "bb_upper", "bb_lower"],
    "barrier_trades": ["entry_price", "exit_price", "target_price", "stop_price"],
    "ema_10_20": ["ema10", "ema20"],
    "gain_loss": ["prev_close", "delta", "gain", "loss"],
    "rsi": ["rsi"],
    "true_range_atr": ["tr", "atr"],
    "rel_volume": ["volume_sma", "rel_volume"],
    "prepared": ["open", "high", "low", "close", "volume", *_INDICATORS],
    "signals": ["close", "rsi"],
    "forward_path": ["step_high", "step_low", "step_close"],
    "candidate_outcomes": ["entry_price", "exit_price", "target_price", "stop_price"],
    "trades": _TRADE_DOUBLES,
    "long_hold_trades": ["pnl_usd", "r_multiple"],
    "custom_strategy_trades": ["pnl_usd"],
    "summary": _SUMMARY_DOUBLES,
    "summary_by_symbol": _SUMMARY_DOUBLES,
    "summary_by_trend": _SUMMARY_DOUBLES,
    "contracts_by_interval": ["strike"],
    "contract_rank_k": ["strike"],
    "contract_rank_spill": ["strike"],
    "contract_rank_clamp": ["strike"],
    "kth_otm_strike": ["strike"],
    "kth_otm_strike_clamp": ["strike"],
    "asof_price": ["entry_quote", "exit_quote"],
    "enriched_summary": _SUMMARY_DOUBLES,
    "trade_log": [
        "option_entry_price", "option_exit_price", "underlying_entry_price", "underlying_exit_price",
        "option_return_pct", "pnl_usd", "r_multiple",
    ],
    "trade_log_overall": ["underlying_exit_price"],
    "example_trades": ["pnl_usd"],
    "trade_context": ["close", "bb_upper", "bb_basis", "bb_lower", "rsi"],
    "trade_context_marks": ["close", "option_return_pct", "entry_price", "exit_price"],
}


def statements() -> dict[str, str]:
    return {name: statement(name) for name in FINAL}
