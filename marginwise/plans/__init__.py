"""Multi-step jobs: training, evaluation, tuning."""
