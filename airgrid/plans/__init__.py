"""Composed jobs: offline training, batch serving, walk-forward backtest."""
