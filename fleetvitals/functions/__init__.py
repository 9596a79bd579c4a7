"""Column helpers shared by the operators."""

from .numeric import early_percent, mean_of, ratio, round_ratio, scaled, times_div, whole, whole_div
from .text import cut, style_100
from .time import seconds_between, shift_millis

__all__ = [
    "cut",
    "early_percent",
    "mean_of",
    "ratio",
    "round_ratio",
    "scaled",
    "seconds_between",
    "shift_millis",
    "style_100",
    "times_div",
    "whole",
    "whole_div",
]
