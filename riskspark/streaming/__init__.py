"""Structured Streaming jobs (scoring stream, daily KPIs, sliding trend)."""
