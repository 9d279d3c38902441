"""tessera: distribution matching, palette analytics and recipe management as Spark DataFrame jobs."""
