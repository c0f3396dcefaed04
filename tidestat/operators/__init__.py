"""The statistics. Importing this package registers all nine."""

from tidestat.operators import crosscor, metaplot, modhist, rates, reads

__all__ = ["crosscor", "metaplot", "modhist", "rates", "reads"]
