"""casewright: evidence analytics as Spark DataFrame operators."""
