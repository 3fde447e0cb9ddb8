"""End-to-end plans: training, validation, scoring, tiles and reports."""
