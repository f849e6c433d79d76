"""Lockstep: joint-failure analytics over entity x item outcome tables, on Spark."""
