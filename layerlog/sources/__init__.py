"""layerlog.sources"""
