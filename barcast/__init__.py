"""barcast: cleaning, forecasting and scoring of many 15-minute bar series on Spark."""

from barcast.config import Params

__all__ = ["Params"]
__version__ = "0.1.0"
