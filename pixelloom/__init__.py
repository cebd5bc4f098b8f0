"""pixelloom: image and image-sequence containers as Spark tables."""
