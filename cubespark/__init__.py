"""cubespark: region-of-interest and time-of-interest queries over gridded cubes, on Spark."""
