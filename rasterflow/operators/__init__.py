"""DataFrame operators over pixels, packed rasters, cues, segments, tracks and events."""
