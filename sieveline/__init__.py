"""Evidence selection and text analytics as Spark DataFrame plans."""
