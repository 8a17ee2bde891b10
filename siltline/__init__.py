"""siltline: Spark-first analytics over captured posts, media, questions and documents."""
