"""Column functions: calendar, arithmetic, costs, sizing."""
