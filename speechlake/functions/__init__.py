"""Column functions and the small numeric designs behind them."""
