"""Score ladders as (threshold, points), first match wins.

``*_UP`` ladders score values above a threshold, ``*_DOWN`` ladders values below one;
the ``ELSE`` table holds the points when no rung matches (0 where absent).
"""

MOMENTUM_1M_UP = [(10, 10), (5, 7), (0, 4), (-5, 2)]
MOMENTUM_3M_UP = [(20, 10), (10, 7), (5, 4), (0, 2)]
MOMENTUM_6M_UP = [(30, 8), (15, 6), (5, 3)]
MOMENTUM_12M_UP = [(50, 7), (25, 5), (10, 3)]
ADX_UP = [(40, 10), (30, 7), (25, 4), (20, 2)]
SURGE_UP = [(1.5, 10), (1.2, 6)]
STABILITY_UP = [(0.7, 10), (0.5, 6)]

VALUE_PE_DOWN = [(10, 15), (15, 12), (20, 8), (25, 4), (30, 1)]
VALUE_PEG_DOWN = [(0.5, 10), (1, 8), (1.5, 5), (2, 2)]
VALUE_PB_DOWN = [(1, 8), (2, 6), (3, 3), (5, 1)]
VALUE_PS_DOWN = [(1, 4), (2, 3), (3, 1)]
VALUE_EV_DOWN = [(8, 3), (12, 2), (15, 1)]
VALUE_MARGIN_UP = [(20, 10), (15, 8), (10, 6), (5, 3), (0, 1)]
VALUE_ROE_UP = [(20, 10), (15, 8), (10, 5), (5, 2)]
VALUE_ROA_UP = [(10, 5), (5, 3), (2, 1)]
VALUE_OPMARGIN_UP = [(20, 5), (15, 4), (10, 2)]
VALUE_DEBT_DOWN = [(0.3, 10), (0.5, 8), (1, 6), (1.5, 3), (2, 1)]
VALUE_CURRENT_UP = [(2, 5), (1.5, 4), (1, 2)]
VALUE_YIELD_UP = [(4, 7), (3, 6), (2, 4), (1, 2)]

GROWTH_REVENUE_UP = [(30, 30), (20, 25), (15, 20), (10, 15), (5, 8)]
GROWTH_EARNINGS_UP = [(25, 25), (20, 20), (15, 15), (10, 10), (5, 5)]
GROWTH_MARGIN_UP = [(20, 12), (15, 9), (10, 6)]
GROWTH_ROE_UP = [(20, 13), (15, 9), (10, 5)]
GROWTH_PEG_DOWN = [(1, 20), (1.5, 15), (2, 10), (2.5, 5)]

SIZE_FROM = [(200e9, 40), (10e9, 60), (2e9, 85), (300e6, 100)]
FIVE_PB_DOWN = [(1, 100), (2, 85), (3, 60), (5, 40)]
FIVE_PE_DOWN = [(10, 100), (15, 85), (20, 60), (30, 40)]
FIVE_PS_DOWN = [(1, 100), (2, 80), (3, 60)]
FIVE_ROE_UP = [(0.30, 100), (0.20, 85), (0.15, 70), (0.10, 55), (0, 40)]
FIVE_OPMARGIN_UP = [(0.25, 100), (0.15, 80), (0.10, 60), (0.05, 40), (0, 20)]
FIVE_MARGIN_UP = [(0.20, 100), (0.15, 85), (0.10, 70), (0.05, 50), (0, 30)]
FIVE_ROA_UP = [(0.15, 100), (0.10, 80), (0.05, 60), (0, 40)]
FIVE_CURRENT_UP = [(2.5, 100), (2, 85), (1.5, 70), (1, 50)]
FIVE_DEBT_DOWN = [(0.3, 100), (0.5, 85), (1, 60), (2, 35)]

QUALITY_ROE_UP = [(0.25, 100), (0.20, 90), (0.15, 75), (0.10, 60), (0.05, 40), (0, 20)]
QUALITY_ROA_UP = [(0.15, 100), (0.10, 85), (0.07, 70), (0.05, 55), (0, 30)]
QUALITY_MARGIN_UP = [(0.20, 100), (0.15, 85), (0.10, 70), (0.05, 50), (0, 25)]
QUALITY_OPMARGIN_UP = [(0.25, 100), (0.20, 85), (0.15, 70), (0.10, 55), (0, 30)]
QUALITY_GROSS_UP = [(0.60, 100), (0.50, 85), (0.40, 70), (0.30, 55)]
QUALITY_DEBT_DOWN = [(0.2, 100), (0.5, 85), (1, 65), (1.5, 45), (2.5, 25)]
QUALITY_CURRENT_UP = [(3, 100), (2.5, 90), (2, 80), (1.5, 65), (1, 45)]
QUALITY_QUICK_UP = [(2, 100), (1.5, 85), (1, 70), (0.7, 50)]
QUALITY_FCF_UP = [(1e9, 100), (5e8, 90), (1e8, 80), (0, 70), (-1e8, 40)]

LOWVOL_VOL_DOWN = [(15, 100), (20, 90), (25, 75), (30, 60), (40, 40), (50, 25)]
LOWVOL_BETA_DOWN = [(0.5, 100), (0.7, 95), (0.85, 85), (1, 75), (1.15, 55), (1.3, 40), (1.5, 25)]
LOWVOL_STABILITY_DOWN = [(0.3, 100), (0.5, 85), (0.7, 70), (1, 55), (1.5, 35)]
LOWVOL_DRAWDOWN_DOWN = [(10, 100), (15, 90), (20, 75), (30, 55), (40, 35), (50, 20)]

SENTIMENT_RATIO_FROM = [(3, 100), (2, 90), (1.5, 75), (1, 60), (0.67, 40), (0.5, 25)]
ARTICLES_FROM = [(20, 50), (10, 40), (5, 30)]

ELSE = {
    "SIZE_FROM": 50,
    "FIVE_PB_DOWN": 20,
    "FIVE_PE_DOWN": 20,
    "FIVE_PS_DOWN": 30,
    "FIVE_ROE_UP": 10,
    "FIVE_OPMARGIN_UP": 10,
    "FIVE_MARGIN_UP": 10,
    "FIVE_ROA_UP": 10,
    "FIVE_CURRENT_UP": 20,
    "FIVE_DEBT_DOWN": 15,
    "QUALITY_ROE_UP": 5,
    "QUALITY_ROA_UP": 5,
    "QUALITY_MARGIN_UP": 5,
    "QUALITY_OPMARGIN_UP": 5,
    "QUALITY_GROSS_UP": 30,
    "QUALITY_DEBT_DOWN": 10,
    "QUALITY_CURRENT_UP": 15,
    "QUALITY_QUICK_UP": 25,
    "QUALITY_FCF_UP": 20,
    "LOWVOL_VOL_DOWN": 10,
    "LOWVOL_BETA_DOWN": 10,
    "LOWVOL_STABILITY_DOWN": 20,
    "LOWVOL_DRAWDOWN_DOWN": 10,
    "SENTIMENT_RATIO_FROM": 10,
}

# Regime -> weight per strategy; strategies not listed weigh 0.5.
REGIME_WEIGHTS = {
    "bull": {"ml_prediction": 0.25, "momentum": 0.25, "growth": 0.20, "news_sentiment": 0.15, "value": 0.08, "fama_french": 0.07},
    "bear": {"ml_prediction": 0.25, "value": 0.25, "quality": 0.20, "fama_french": 0.15, "news_sentiment": 0.10, "momentum": 0.05},
    "high_volatility": {"ml_prediction": 0.30, "quality": 0.25, "low_volatility": 0.20, "value": 0.15, "news_sentiment": 0.10},
    "sideways": {"ml_prediction": 0.25, "value": 0.20, "momentum": 0.18, "growth": 0.15, "news_sentiment": 0.12, "fama_french": 0.10},
    "risk_on": {"ml_prediction": 0.25, "momentum": 0.35, "growth": 0.20, "news_sentiment": 0.12, "value": 0.08},
    "risk_off": {"ml_prediction": 0.25, "quality": 0.35, "value": 0.18, "low_volatility": 0.15, "news_sentiment": 0.07},
}
STRATEGIES = ["momentum", "value", "growth", "fama_french", "quality", "low_volatility", "news_sentiment", "ml_prediction"]

# Optimisation parameters per three-state regime.
REGIME_PARAMETERS = {
    "crisis": {"target_beta": 0.8, "beta_tolerance": 0.25, "max_weight": 0.04, "n_stocks": 50, "risk_aversion": 2.0},
    "high_vol": {"target_beta": 0.9, "beta_tolerance": 0.25, "max_weight": 0.045, "n_stocks": 45, "risk_aversion": 1.5},
    "normal": {"target_beta": 1.05, "beta_tolerance": 0.20, "max_weight": 0.05, "n_stocks": 40, "risk_aversion": 1.0},
}
