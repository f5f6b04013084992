"""Column functions: rounding, colours, blending, times, samples, media types."""
