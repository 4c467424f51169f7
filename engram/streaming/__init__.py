"""The stateful, time-driven behaviours as Structured Streaming, with batch forms of the same folds."""
