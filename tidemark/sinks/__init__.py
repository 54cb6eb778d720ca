"""Batch outputs: the reading dataset, exports, state tables and snapshots."""
