"""DataFrame in, DataFrame out; each works on a batch and, where it makes sense, on a stream."""
