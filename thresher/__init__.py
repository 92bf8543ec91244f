"""thresher: windowed threshold rules over event tables, on Spark.

A rule says which events to keep (a filter tree), how to group them, which
aggregates to compute per tumbling time window, and which combination of
aggregates counts as a breach.  The package compiles such a rule into plain
DataFrame expressions (no SQL text is built) and runs it as a batch backtest
or as a Structured Streaming job.  Around that core it offers breakdowns of
the matched events, analytics over stored rule results, a live per-rule view
in which partial window results are replaced by final ones, versioned rule
tables and access reports.
"""

from thresher.spec import RuleSpec  # noqa: F401

__all__ = ["RuleSpec"]
