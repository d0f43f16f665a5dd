"""assayloom: laboratory, sequencing and corpus analytics as plain PySpark DataFrame functions."""
