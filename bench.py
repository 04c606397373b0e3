"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is built from fresh inputs (no shared stored tables between queries) and its
whole result is written to the no-op sink. The time is the second of two runs for short
queries, so that class loading is not counted; a query over 20 s is run once.
"""

from __future__ import annotations

import json
import os
import sys
import time

from quantloom.operators import factors, learn, news, panel, risk, technical, validation
from quantloom.operators.universe import enough_returns
from quantloom.plans.derived import Market
from quantloom.plans.momentum import momentum_book_report
from quantloom.plans.monthly import feature_table
from quantloom.plans.walkforward import boosted_scorer, fold_scores, report
from quantloom.session import local_session, reliable


def walk_forward(m: Market):
    """Features, yearly folds with three boosted models each, books, returns and cost."""
    columns = [*learn.MODEL_RAW, *[f"{c}_rank" for c in learn.MODEL_RAW]]
    rows = reliable(feature_table(m.prices(), m.bench(), m.meta()).select("ticker", "date", *columns, "target_binary"))
    return report(fold_scores(rows, columns, boosted_scorer(columns)), m.prices(), m.bench())


def queries(folder: str):
    def fresh(spark):
        return Market(spark, folder)

    return {
        "prices": lambda s: fresh(s).prices(),
        "daily_returns": lambda s: fresh(s).returns(),
        "bar_features": lambda s: fresh(s).bars(),
        "feature_table": lambda s: feature_table(fresh(s).prices(), fresh(s).bench(), fresh(s).meta()),
        "momentum_book": lambda s: momentum_book_report(fresh(s).prices(), fresh(s).bench(), fresh(s).meta()),
        "trailing_beta": lambda s: panel.trailing_beta(fresh(s).prices(), fresh(s).bench()),
        "smoothed_indicators": lambda s: technical.smoothed_indicators(fresh(s).prices()),
        "screen_analyses": lambda s: fresh(s).analyses(),
        "strategy_tear_sheet": lambda s: risk.tear_sheet(fresh(s).strategy_returns()),
        "bootstrap": lambda s: validation.bootstrap(reliable(fresh(s).strategy_returns()), "excess_return", n_iter=10_000),
        "covariance": lambda s: factors.covariance(reliable(enough_returns(fresh(s).returns(), missing_share=0.8))),
        "walk_forward": lambda s: walk_forward(fresh(s)),
        "news_sentiment": lambda s: news.aggregate(fresh(s).news()),
    }


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    only = set(sys.argv[1:])
    times: dict[str, float] = {}
    for name, build in queries(folder).items():
        if only and name not in only:
            continue
        for attempt in range(2):
            start = time.time()
            build(spark).write.format("noop").mode("overwrite").save()
            times[name] = round(time.time() - start, 2)
            if times[name] > 20:
                break
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 2), "unit": "sec", "queries": times, "sf": folder.rstrip("/").rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
