"""A forest analytics engine on Spark: forests are tables, answers are queries."""
