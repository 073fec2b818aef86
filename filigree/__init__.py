"""Batch analytics over company filings and the questions asked about them."""
