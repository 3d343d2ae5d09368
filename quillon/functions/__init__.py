"""Functions: Column builders, and Arrow UDFs where no expression will do."""
