"""panelkit: tick bars, factor panels and factor evaluation on PySpark."""

from panelkit.operators.bars import BaseBar, DollarBar, TickBar, TimeBar, VolumeBar
from panelkit.operators.evaluate import FactorEvaluator
from panelkit.operators.factor import BaseFactor, Factor, factors_df
from panelkit.operators.functional import register_operator
from panelkit.operators.panel import AggBar, Panel
from panelkit.operators.plotdata import FactorPlotter
from panelkit.plans.parser import FactorExpressionParser
from panelkit.sources.store import Store

__all__ = [
    "AggBar", "BaseBar", "BaseFactor", "DollarBar", "Factor", "FactorEvaluator", "FactorExpressionParser", "FactorPlotter",
    "Panel", "Store", "TickBar", "TimeBar", "VolumeBar", "factors_df", "register_operator",
]
