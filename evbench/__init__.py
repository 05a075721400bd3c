"""Evidence-benchmark engine on Spark: declarative operators for building and auditing leakage-resistant benchmarks."""
