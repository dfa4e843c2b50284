"""Column functions: canonical values, JSON paths, text analysis, vector maths."""
