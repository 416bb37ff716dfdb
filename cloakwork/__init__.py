"""Text de-identification as Spark jobs: detect, mask, review, apply and restore."""
