"""DataFrame → DataFrame jobs: cleaning, quality rules, metrics, evaluations, alerts."""
