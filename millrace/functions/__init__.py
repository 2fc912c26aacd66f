"""Column functions over text: native Spark expressions, and Arrow functions where Spark has none."""
