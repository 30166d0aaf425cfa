import datetime as dt

import pytest
from conftest import BASIC_START_END, PREMIUM_START_END

from growthgrain.plans import subscriptions as subs
from growthgrain.schemas import SUBSCRIPTIONS


def test_key_figures(subscriptions):
    current = subs.current_subscriptions(subscriptions).first()
    assert current["date"] == dt.date(2024, 11, 1)
    assert current["total_subscriptions"] == 1535 and current["total_text"] == "1,535"
    assert subs.most_popular_type(subscriptions).first()["subscription_type"] == "Basic"
    assert subs.months_tracked(subscriptions).first()["months_tracked"] == 12


def test_most_popular_tie_goes_to_the_first_name(spark):
    day = dt.date(2024, 1, 1)
    tied = spark.createDataFrame([(day, "b", 5), (day, "a", 5), (day, None, 9)], SUBSCRIPTIONS)
    assert subs.most_popular_type(tied).collect() == [("a", 5)]


def test_trend(subscriptions):
    def trend(*args):
        return [r["active_subscriptions"] for r in subs.subscription_trend(subscriptions, *args).collect()]

    assert trend("Basic", ("2024", "01"), ("2024", "03")) == [849, 880, 853]
    assert len(trend()) == subscriptions.count()
    assert trend("All", (2024, 3), (2024, 1)) == []
    types = [r["subscription_type"] for r in subs.subscription_trend(subscriptions).collect()]
    assert types == sorted(types)


def test_trend_holds_the_whole_table_by_default(spark):
    rows = [(dt.date(2019 + i // 2, 1 + 5 * (i % 2), 1), "a", i) for i in range(14)]
    table = spark.createDataFrame([*rows, (None, "a", 99)], SUBSCRIPTIONS)
    assert [r[2] for r in subs.subscription_trend(table).collect()] == list(range(14))
    assert len(subs.subscription_trend(table, start=(2021, 1)).collect()) == 10
    assert len(subs.subscription_trend(table, end=(2021, 1)).collect()) == 5


def test_pivot_loses_no_type(subscriptions):
    assert subs.net_change_pivot(subscriptions).columns == ["year", "Basic", "Premium"]
    with pytest.raises(Exception, match="type without a column: Premium"):
        subs.net_change_pivot(subscriptions, ["Basic"]).collect()


def test_net_change(subscriptions):
    found = {
        (r["year"], r["subscription_type"]): (r["start_of_year"], r["end_of_year"], r["net_change"])
        for r in subs.net_change_by_year(subscriptions).collect()
    }
    for name, years in (("Basic", BASIC_START_END), ("Premium", PREMIUM_START_END)):
        for year, (first, last) in years.items():
            assert found[year, name] == (first, last, last - first)


@pytest.mark.parametrize("types", [None, ["Basic", "Premium"]])
def test_net_change_pivot(subscriptions, types):
    table = [tuple(r) for r in subs.net_change_pivot(subscriptions, types).collect()]
    assert table == [(2020, -99, 61), (2021, 27, 73), (2022, -47, -11), (2023, 28, 57), (2024, 36, -99)]


def test_net_change_skips_missing_counts(spark):
    rows = [
        (dt.date(2024, 1, 1), "a", None),
        (dt.date(2024, 2, 1), "a", 3),
        (dt.date(2024, 5, 1), "a", 10),
        (dt.date(2024, 6, 1), "a", None),
        (dt.date(2024, 1, 1), "b", None),
    ]
    table = subs.net_change_by_year(spark.createDataFrame(rows, SUBSCRIPTIONS)).collect()
    assert [tuple(r) for r in table] == [(2024, "a", 3, 10, 7), (2024, "b", None, None, None)]


def test_selectors(subscriptions):
    assert [r[0] for r in subs.selector_types(subscriptions).collect()] == ["All", "Basic", "Premium"]
    assert [r[0] for r in subs.selector_years(subscriptions).collect()] == [2020, 2021, 2022, 2023, 2024]
    months = [r[0] for r in subs.selector_months(subscriptions).collect()]
    assert months == [f"{m:02d}" for m in range(1, 13)]
