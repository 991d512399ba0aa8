"""The fixtures reach every branch: seen in the SQL's results, not in ours."""

from __future__ import annotations

import os

import pytest

from oracle import connect
from wickline.catalog import oracles

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")

LISTED = {"ok", "reference_api_error:reference_empty", "contract_not_found", "missing_contract_ticker", "no_price_bars:empty", "missing_entry_or_exit_price"}
CHAIN = {"ok", "no_chain_from_yahoo", "no_matching_expiry", "historical_chain_unavailable", "contract_not_found", "no_price_bars", "missing_entry_or_exit_price"}


@pytest.fixture(scope="module")
def results():
    con = connect(SF_DIR)

    def rows(name):
        cursor = con.execute(oracles.statement(name))
        names = [d[0] for d in cursor.description]
        return [dict(zip(names, r)) for r in cursor.fetchall()]

    return rows


@pytest.mark.parametrize("name, statuses", [("lookup_branches_agg", LISTED), ("lookup_branches_chain", CHAIN)])
def test_every_status_occurs(results, name, statuses):
    found = results(name)
    assert {r["option_lookup_status"] for r in found} == statuses
    assert sum(r["option_entry_price"] is not None for r in found) >= 10


def test_expiries_near_far_and_missing(results):
    days = [r["days_to_expiry"] for r in results("nearest_expiry_varied")]
    known = {d for d in days if d is not None}
    assert None in days and max(known) > 10 and len([d for d in known if d <= 10]) > 5


def test_chain_prices_change_trades(results):
    found = results("repriced_chain")
    assert {r["pricing_mode"] for r in found} == {"yahoo_real", "synthetic"}


def test_signals_with_and_without_room(results):
    assert {r["eligible"] for r in results("eligible_signals")} == {True, False}


def test_gates_let_some_signals_through(results):
    every = len(results("signals"))
    for name in ("volume_gate", "volume_gate_level"):
        assert 0 < sum(r["signals"] for r in results(name)) < every


def test_prices_before_and_after_the_moment(results):
    """Quotes only in the morning: the last one before the exit is used."""
    con = connect(SF_DIR)
    steps = oracles.statement("lookup_branches_chain")
    steps = steps[: steps.rindex("select columns(*)") if "select columns(*)" in steps else steps.rindex(" select ")]
    back = con.execute(
        steps
        + """ select count(*) from chain_found_odd f join reachable_odd p using (symbol, entry_time)
              where status = 'ok' and not exists (select 1 from quotes_odd q where q.ticker = p.ticker and q.ts >= f.exit_time
                    and q.session_date between f.session_date and cast(f.exit_local as date))"""
    ).fetchone()[0]
    assert back > 0


def test_barriers_of_every_kind(results):
    assert len({r["exit_reason"] for r in results("barrier_trades")}) >= 3
