"""Name analytics as Spark jobs: corpora, rules, candidates, audits and evaluations."""
