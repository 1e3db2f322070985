"""DataFrame operators over series, surrogates, evaluations, gates and forecasts."""
