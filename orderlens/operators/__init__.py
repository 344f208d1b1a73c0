"""Reusable DataFrame steps: cleaning, the delivered-order base, data-quality audits."""
